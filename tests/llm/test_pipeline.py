"""The stages of the pipeline against what they must keep."""

import re
from collections import defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from test_corpus import components, documents
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from weirflow.llm import langid, packing
from weirflow.llm.mixing import mix_sources
from weirflow.shared import fresh_path, written


def test_stages(spark):
    docs = {i: t for i, t in documents(11).items()}
    sf_dir = fresh_path(spark, "tables")
    rows = [(i, t, "en" if i % 7 else None, f"s{i % 3}", len(t or "")) for i, t in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf_dir}/documents.parquet")
    df, kept = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, df, sf_dir), name)
        assert out.columns == df.columns
        kept[name] = {r.doc_id: r.text for r in out.collect()}
        df = out
    assert all(any(map(str.isalpha, t)) for t in kept["language"].values())
    model = langid.fit(spark.read.parquet(f"{sf_dir}/documents.parquet").filter(~langid.held_out(F.col("doc_id"))))
    said = dict(zip(docs, model.predict(list(docs.values())), strict=True))
    assert sorted(kept["language"]) == sorted(i for i, (lang, score) in said.items() if lang != "und" and score >= 0.05)
    prose = [i for i, t in docs.items() if t and all(re.fullmatch("(ka|lo|mi|re|tu|vo)(n|st||x|ra|el)", w) for w in t.split()) and len(t) > 20]
    assert len(prose) > 60 and set(prose) <= set(kept["language"])
    first = {}
    for i in sorted(kept["language"]):
        first.setdefault(kept["language"][i], i)
    assert sorted(kept["exact"]) == sorted(first.values())
    assert sorted(kept["near"]) == sorted(i for i, (_, c) in components(kept["exact"]).items() if c == i)
    assert kept["mixing"] == kept["near"]
    pieces = corpus_pipeline.STAGES[-1][1](spark, df, sf_dir).collect()
    whole = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in whole) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in pieces)
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, t in kept["mixing"].items():
        n = len(tok.encode(t, add_special_tokens=False).ids) + 1
        assert sum(r.length for r in pieces if r.doc_id == i) == n
    bins = {}
    for r in pieces:
        bins[r.sequence_id] = bins.get(r.sequence_id, 0) + r.length
    assert max(bins.values()) <= 1024 and np.sum(list(bins.values())) == sum(r.length for r in pieces)


EXTRA = ["h", "t", "row", "place", "_file", "_row", "_metadata", "key", "rep", "n", "comp", "u", "v", "c0", "_source", "group", "length", "piece", "_h"]


def odd_table(spark, rows):
    extra = "".join(f", `{c}` string" for c in EXTRA)
    filled = [(*r, *[f"{c}{r[0]}" for c in EXTRA], {"k": r[0]}) for r in rows]
    return spark.createDataFrame(filled, f"doc_id long, text string, lang string, source string, n_chars long{extra}, m map<string,long>")


def test_stages_with_odd_tables(spark):
    """Nulls everywhere, repeated rows, equal ids, a very long text, clashing names and a map; then nothing at all."""
    say = lambda k, n: " ".join(f"ka{(k * 7 + j * j) % 97}st" for j in range(n))
    rows = [(i, say(i, 30 + i), "en", "a", 1) for i in range(40)]
    rows += [(None, say(99, 40), "en", None, None), (None, say(99, 40), None, "b", None), (41, None, "en", "a", 0), (42, "", None, None, 0), (43, "12 !?", "en", "a", 0)]
    rows += [rows[3]] * 3 + [(7, say(123, 50), "en", "b", 5), (50, say(5, 200_000), "en", "c", 0), (51, say(5, 200_000) + " end", None, "c", 0)]
    for some in (rows, []):
        sf_dir = fresh_path(spark, "tables")
        odd_table(spark, some).write.parquet(f"{sf_dir}/documents.parquet")
        df = spark.read.parquet(f"{sf_dir}/documents.parquet")
        schema, kept = df.schema, []
        for name, stage in corpus_pipeline.STAGES[:-1]:
            df = written(stage(spark, df, sf_dir), name)
            assert df.schema.simpleString() == schema.simpleString()
            kept.append(df.select("doc_id", "text", "place", "m").collect())
            assert all(r.place == f"place{r.doc_id}" and r.m == {"k": r.doc_id} for r in kept[-1])
        pieces = corpus_pipeline.packing(spark, df, sf_dir).collect()
        assert {r.doc_id for r in pieces} == {r.doc_id for r in kept[-1]} and sum(r.piece == 0 for r in pieces) == len(kept[-1])
        assert corpus_pipeline.run(spark, sf_dir).count() == len(pieces)
        if some:
            language, exact, near, mixing = (sorted((r.doc_id is None, r.doc_id or 0) for r in k) for k in kept)
            ids = lambda k: [i for null, i in k if not null]
            assert not {41, 42, 43} & set(ids(language)) and ids(language).count(3) == 4 and ids(exact).count(3) == 1
            assert (True, 0) in exact and exact.count((True, 0)) == 1 and ids(exact).count(7) == 2
            assert 50 in ids(near) and 51 not in ids(near) and mixing == near


def test_packing_follows_the_mixture(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 100)
    rows = [(i, f"word{i} " * (1 + i % 90) if i % 50 else "long text " * 3000, "en", "ab"[i % 2], 0) for i in range(600)]
    docs = written(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "docs")
    found = {}
    for heavy in "ab":
        mixed = written(corpus_pipeline.mixing(spark, docs, "", {k: 9.0 if k == heavy else 1.0 for k in "ab"}), "mixed")
        order = mix_sources(docs, weights={k: 9.0 if k == heavy else 1.0 for k in "ab"})
        place = {r.doc_id: k for k, r in enumerate(sorted(order.collect(), key=lambda r: r.place))}
        members = defaultdict(list)
        for r in corpus_pipeline.packing(spark, mixed, "").collect():
            members[r.sequence_id].append((place[r.doc_id], r.piece, r.offset, r.length))
        # every sequence lies in one range of 100 documents, is without gaps, and sequences ascend with the mixture
        for v in members.values():
            assert len({p // 100 for p, *_ in v}) == 1
            v.sort(key=lambda x: x[2])
            assert [x[2] for x in v] == [sum(y[3] for y in v[:k]) for k in range(len(v))] and sum(x[3] for x in v) <= 1024
        firsts = [min(members[k])[:2] for k in sorted(members)]
        assert firsts == sorted(firsts) and sorted({p for v in members.values() for p, *_ in v}) == list(range(600))
        found[heavy] = [sorted((p, n) for p, n, *_ in v) for _, v in sorted(members.items())], place
    first = {k: [i for i, p in place.items() if p < 100] for k, (_, place) in found.items()}
    assert sum(i % 2 == 0 for i in first["a"]) > 80 and sum(i % 2 for i in first["b"]) > 80
    assert found["a"][0] != found["b"][0]


def test_registration():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(k.startswith(f"op{n}_") for k in names) for n in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names)
