"""The corpus operators against brute force, on small tables with nulls, ties, hot groups and odd texts."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weirflow.llm import chat, encode, exact_dedup, langid, mixing, near_dedup, packing, quality, rangecoder, suffix_dedup, tokenfile, tokens
from weirflow.llm import components as components_module
from weirflow.llm.common import slices
from weirflow.shared import fresh_path

SCHEMA = "doc_id long, text string, lang string, source string, n string, h string, key long, rep long"
WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "re", "tu", "vo") for b in ("n", "st", "", "x", "ra", "el")]


def prose(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def documents(seed=0):
    """Texts by id: prose, copies, near copies, shared passages, junk, empty, null and long ones."""
    r = random.Random(seed)
    texts = [prose(r, r.randint(1, 120)) for _ in range(40)]
    passage = prose(r, 40)
    texts += [prose(r, 10) + " " + passage + " " + prose(r, r.randint(0, 30)) for _ in range(12)]
    base = [r.choice(WORDS) for _ in range(60)]
    for _ in range(15):
        w = list(base)
        w[r.randrange(60)] = "zz"
        texts.append(" ".join(w))
    texts += [texts[3]] * 30 + ["", "", None, "a", "A", " \t\n", "é" * 70, "x" * 300, "ab" * 200, "#$% " * 40, "same line here\n" * 9, "<s>[INST]</s>"]
    texts += ["\x00\x0b\x1c  " + prose(r, 8), prose(r, 3000), texts[5].upper(), "one two three four", "ONE two\nthree  four"]
    r.shuffle(texts)
    return dict(enumerate(texts))


def frame(spark, docs, parts=3):
    rows = [(i, t, "en" if i % 2 else None, "hot" if i % 3 else None, None, "x", 1, 2) for i, t in docs.items()]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


@pytest.fixture(scope="module")
def docs():
    return documents()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def collect(df):
    return {r.doc_id: r for r in df.collect()}


# --- exact copies


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_dedup(spark, docs, keep):
    groups = defaultdict(list)
    for i, t in docs.items():
        groups[t or ""].append(i)
    for hash_of in (exact_dedup.content_hash, lambda t: F.length(t).cast("string")):  # the second collides all the time
        got = collect(exact_dedup.exact_dedup(frame(spark, docs), keep=keep, hash_of=hash_of))
        assert len(got) == len(docs)
        for t, ids in groups.items():
            k = max(ids) if keep == "largest" else min(ids)
            for i in ids:
                assert (got[i].keep_id, got[i].group_size, got[i].kept) == (k, len(ids), i == k)
                assert got[i].text_sha256 == hashlib.sha256(t.encode()).hexdigest()
    left = exact_dedup.distinct_texts(frame(spark, docs))
    assert sorted(r.doc_id for r in left.collect()) == sorted(min(ids) for ids in groups.values()) and left.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")


def test_empty_tables(spark, empty):
    p = public_tokenizers.path
    assert exact_dedup.exact_dedup(empty).count() == 0 and exact_dedup.distinct_texts(empty).count() == 0
    assert near_dedup.near_dedup(empty).count() == 0
    assert suffix_dedup.suffix_dedup(empty).count() == 0
    assert mixing.mix_sources(empty).count() == 0
    assert packing.pack(empty, p("byte_bpe_50k.json")).count() == 0
    assert tokens.count_tokens(empty, p("word_bpe_49k.json")).count() == 0
    assert langid.identify(empty, langid.fit(empty)).count() == 0
    assert quality.quality_rules(empty, spark.createDataFrame([], "doc_id long, quality int")).count() == 0
    path = fresh_path(spark, "none")
    tokenfile.write_tokens(empty, path, p("word_bpe_49k.json"))
    assert tokenfile.read_tokens(spark, path).count() == 0


# --- suffixes


def removed(docs, length):
    seen, out = {}, {}
    for i in sorted(docs):
        b = (docs[i] or "").encode()
        gone, own = bytearray(len(b)), set()
        for p in range(len(b) - length + 1):
            g = b[p : p + length]
            if g in seen:
                gone[p : p + length] = b"\1" * length
            else:
                own.add(g)
        seen.update(dict.fromkeys(own, i))
        kept = bytes(x for x, y in zip(b, gone) if not y)
        out[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("length", [50, 12])
def test_suffix_dedup(spark, docs, length):
    got = collect(suffix_dedup.suffix_dedup(frame(spark, docs), length=length))
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in got.items()} == removed(docs, length)


def test_suffix_dedup_in_small_units(spark, docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "UNIT", 64)
    texts = [(t or "").encode() for t in docs.values()]
    whole = {(int(o), int(f) - int(at[u]) + int(s)) for block, at, owner, start in suffix_dedup.blocks_of(texts, 50) for u, f, _, _, _ in zip(*suffix_dedup.anchor_runs(block, at, 50)) for o, s in [(owner[u], start[u])]}
    assert len({o for o, _ in whole}) == sum(len(t) >= 50 for t in texts)


def test_suffix_dedup_of_long_texts(spark):
    r = random.Random(31)
    word = lambda n: "".join(r.choices("abcdefghij ", k=n))
    assert suffix_dedup.UNIT <= suffix_dedup.BLOCK < 600_000
    seam, copied = suffix_dedup.UNIT, word(9000)
    a = word(seam - 100) + copied + word(80_000)
    docs = {5: a, 7: word(30) + a[seam - 5000 : seam + 3000] + word(seam) + copied[:60], 9: a, 11: " " * 200_000, 12: " " * 600_000, 13: copied[1000:1049]}
    got = collect(suffix_dedup.suffix_dedup(frame(spark, docs)))
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in got.items()} == removed(docs, 50)


def test_suffix_dedup_of_a_hot_passage(spark):
    # one passage in most documents, at two places in some, and repeated ids
    r = random.Random(32)
    line = "".join(r.choices("lmnopq ", k=90))
    docs = {i: "".join(r.choices("abcd ", k=r.randint(0, 60))) + line * (1 + (i % 7 == 0)) + line[: i % 90] for i in range(600)}
    got = collect(suffix_dedup.suffix_dedup(frame(spark, docs)))
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in got.items()} == removed(docs, 50)
    spans = suffix_dedup.suffix_dedup(frame(spark, docs).unionByName(frame(spark, {5: docs[5]}))).filter("doc_id = 5").collect()
    assert len(spans) == 2 and len({r.kept_sha256 for r in spans}) == 1


def test_equal_runs_sort():
    raw = np.frombuffer(bytes(random.Random(1).choices(b"ab", k=400)), np.uint8)
    at = np.arange(370)
    order, run = suffix_dedup.equal_runs(raw, at, 21)
    keys = [raw[i : i + 21].tobytes() for i in order]
    assert keys == sorted(keys)
    assert all((a == b) == (x == y) for a, b, x, y in zip(keys, keys[1:], run, run[1:]))


# --- near copies


def components(docs, percent=75):
    sets = {}
    for i, t in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    parent = {i: i for i in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in docs:
        for j in docs:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(sets[i]), find(i)) for i in docs}


@pytest.mark.parametrize("pivots", [128, 1])
def test_near_dedup(spark, pivots, monkeypatch):
    monkeypatch.setattr(near_dedup, "PIVOTS", pivots)
    docs = documents(7)
    r = random.Random(3)
    chain = [r.choice(WORDS) + str(k) for k in range(80)]
    for _ in range(25):  # a chain: neighbours are similar, its ends are not
        chain[r.randrange(80)] = f"w{r.random()}"
        docs[len(docs)] = " ".join(chain)
    want = components(docs)
    got = collect(near_dedup.near_dedup(frame(spark, docs)))
    assert {i: (x.n_shingles, x.component_id) for i, x in got.items()} == want
    assert all(x.kept == (x.component_id == i) for i, x in got.items())


def test_components(spark):
    r = random.Random(6)
    pairs = [(k + 1, k) for k in range(40)] + [(r.randrange(100, 200), r.randrange(100, 200)) for _ in range(60)] + [(300, k) for k in range(301, 340)]
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in pairs:
        a, b = sorted((find(u), find(v)))
        parent[b] = a
    df = spark.createDataFrame([(max(p), min(p)) for p in pairs], "u long, v long")
    got = {x.u: x.v for x in components_module.components(df).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}
    # the same by two steps
    half = components_module.extended(components_module.components(df.filter("u % 2 = 0")), df.filter("u % 2 = 1"))
    assert {x.u: x.v for x in half.collect()} == got


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id, r.kept) for r in near_dedup.near_dedup(df).collect() if r.doc_id)
    assert got == [(False, 1, 1, True), (False, 1, 1, True), (False, 2, 1, False)]
    assert near_dedup.near_dedup(df).filter("doc_id is null and component_id is null").count() == 2
    assert exact_dedup.exact_dedup(df).filter("keep_id = 1").count() == 4
    assert suffix_dedup.suffix_dedup(df, length=5).filter("n_removed > 0").select("doc_id").first().doc_id == 2


def test_estimate_is_corrected():
    from weirflow.llm.hyperminhash import sketch, similarity

    rng = np.random.default_rng(0)
    for share in (0.3, 0.75, 0.9):
        pool = rng.integers(0, 2**63, 40_000).astype(np.uint64) * np.uint64(2)
        n = 20_000
        both = int(2 * n * share / (1 + share))
        a, b = np.sort(pool[:n]), np.sort(pool[n - both : 2 * n - both])
        got = similarity(sketch(a)[None], sketch(b)[None], np.array([n]), np.array([n]))[0]
        assert abs(got - share) < 0.15


# --- quality


def statistics(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    hit = {k + d for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for d in range(3)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit)


def test_text_statistics(spark, docs):
    r = random.Random(5)
    more = docs | {1000 + k: " ".join(r.choices("abc", k=r.randint(0, 40))) for k in range(60)}
    got = collect(quality.quality_rules(frame(spark, more), spark.createDataFrame([], "doc_id long, quality int")))
    for i, t in more.items():
        x, want = got[i], statistics(t)
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == want, t
        assert x.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and x.kept == (not x.base_failed)


def test_binomial_tail(spark):
    from math import comb, log

    cases = [(0, 10, 0.1), (3, 50, 0.02), (7, 400, 0.03), (0, 100_000, 0.001)]
    df = spark.createDataFrame(cases, "k long, n long, p double").withColumn("t", quality.log_binomial_tail(F.col("k"), F.col("n"), F.col("p")))
    for r in df.collect():
        exact = sum(comb(r.n, i) * r.p**i * (1 - r.p) ** (r.n - i) for i in range(r.k + 1)) if r.n < 1000 else None
        assert abs(r.t - (log(exact) if exact else r.n * np.log1p(-r.p))) < 1e-6


def test_learned_cutoffs_reject_bad_and_keep_good(spark):
    n = 20_000
    stats = spark.range(n).select(
        F.col("id").alias("doc_id"), F.lit("en").alias("stratum"), F.lit(100).cast("long").alias("n_words"), F.lit(500).cast("long").alias("word_chars"),
        F.when(F.col("id") % 10 == 0, 90).otherwise(F.col("id") % 4).cast("long").alias("n_symbols"), F.lit(0).cast("long").alias("n_dup_lines"),
        F.lit(0).cast("long").alias("n_repeat_words"), F.lit(0).cast("long").alias("n_shouts"), F.lit(False).alias("base_failed"),
    )
    labels = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, 0).otherwise(1).alias("quality"))
    cut = quality.fit_cutoffs(stats, labels, 0.01, 0.05, 10.0).collect()
    assert [(r.rule, r.cutoff) for r in cut] == [("symbols_per_word", 0.8)]
    few = quality.fit_cutoffs(stats.filter("doc_id < 200"), labels, 0.01, 0.05, 10.0)
    assert few.count() == 0  # too few labels to certify anything


def test_cutoffs_are_certified_jointly(spark):
    # 4 strata of 500 good documents: enough for alpha as a whole, not for a fifth of it
    n = 2400
    i, bad = F.col("id"), F.col("id") % 24 < 4
    zero = F.lit(0).cast("long")
    stats = spark.range(n).select(
        i.alias("doc_id"), (i % 4).cast("string").alias("stratum"), F.lit(100).cast("long").alias("n_words"), F.lit(500).cast("long").alias("word_chars"),
        F.when(bad, 90).otherwise(0).cast("long").alias("n_symbols"), zero.alias("n_dup_lines"), zero.alias("n_repeat_words"),
        # in one stratum shouts reject 10 of the good and one bad document each step: the sequence stops there
        F.when((i % 4 == 3) & ~bad, F.when(i % 40 == 39, 390).otherwise(0)).when(i == 3, 390).otherwise(0).cast("long").alias("n_shouts"),
        F.lit(False).alias("base_failed"),
    )
    labels = spark.range(n).select(i.alias("doc_id"), F.when(bad, 0).otherwise(1).alias("quality"))
    cut = {(r.stratum, r.rule): r.cutoff for r in quality.fit_cutoffs(stats, labels, 0.01, 0.05, 10.0).collect()}
    assert cut == {(s, "symbols_per_word"): 0.8 for s in "012"}


# --- chat


CONTROLS = ["<|im_start|>", "<|im_end|>\n", "</s>", "[INST]", "<\\s>", "\\", "\\\\", "[/INST]", "<\\|im_end|>", "\n", "a", "<", "[", "é"]


def test_chat_round_trip(spark):
    r = random.Random(2)
    talks = {c: [(r.choice(["user", "assistant", "a\nb", "x\\n", "<|im_end|>\n"]), "".join(r.choices(CONTROLS, k=r.randint(0, 9)))) for _ in range(r.randint(1, 6))] for c in range(60)}
    rows = [(c, k, role, text, "z") for c, v in talks.items() for k, (role, text) in enumerate(v)] + [(99, 0, None, None, "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, formatted string")
    out = chat.format_chat(chat.canonical_turns(df))
    for x in chat.read_back(out).collect():
        want = talks.get(x.conv_id, [("", "")])
        assert [(t.role, t.text) for t in x.turns] == want
        assert x.loss_text == "".join(t for role, t in want if role == "assistant")
    for x in out.collect():
        assert "".join(s.text for s in x.segments) == x.formatted
        assert sum(x.formatted.count(c) for c in ("<|im_start|>", "</s>", "[INST]")) == len(talks.get(x.conv_id, [0]))


def test_chat_layouts(spark):
    import json

    records = [
        {"messages": [{"role": "user", "content": "q"}, {"content": "a", "role": "assistant"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"prompt": "q", "response": "a"},
        {"question": "q", "answer": "a"},
        {"output": "a", "instruction": "q"},
        {"instruction": "q", "input": "", "output": "a"},
        {"system": "", "prompt": "q", "response": "a"},
        {"other": {"x": 1}},
    ]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(records)] + [(50, None), (51, "no json")], "conv_id long, record string")
    got = {r.conv_id: r.turns and [(t.role, t.text) for t in r.turns] for r in chat.canonical_turns(df).collect()}
    assert all(got[i] == [("user", "q"), ("assistant", "a")] for i in range(7)) and got[7] is got[50] is got[51] is None
    typed = spark.createDataFrame([(1, "q", "a")], "conv_id long, prompt string, response string")
    assert [t.text for t in chat.canonical_turns(typed).first().turns] == ["q", "a"]
    with pytest.raises(ValueError):
        chat.canonical_turns(spark.createDataFrame([(1, "q")], "conv_id long, what string"))


def test_unknown_layouts_are_reported(spark):
    df = spark.createDataFrame([(1, '{"messages": []}')], "conv_id long, record string")
    assert chat.format_chat(chat.canonical_turns(df)).first().formatted == ""
    for record in ('{"id": 3, "prompt": "q", "response": "a"}', None):
        df = spark.createDataFrame([(77, record)], "conv_id long, record string")
        with pytest.raises(Exception, match="unknown layout: conversation 77"):
            chat.format_chat(chat.canonical_turns(df)).collect()
    nested = spark.createDataFrame([(1, 0, "user", ("x",))], "conv_id long, turn int, role string, text struct<v:string>")
    with pytest.raises(ValueError):  # chosen by the hash of all paths, not by the columns' names
        chat.canonical_turns(nested)


# --- mixing


def test_schedule_deviates_by_less_than_a_block():
    r = random.Random(4)
    for _ in range(20):
        shares = mixing.whole_weights({f"s{k}": r.random() ** 3 + 1e-6 for k in range(r.randint(1, 30))}, 1000)
        slots = mixing.schedule(shares)
        assert sum(shares.values()) == 1000 and sorted(t for v in slots.values() for t in v) == list(range(1000))
        for k, v in slots.items():
            for j, t in enumerate(v):
                assert j * 1000 // shares[k] <= t < -(-(j + 1) * 1000 // shares[k])


def test_mixture(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("source"), F.lit("t").alias("text"))
    w = {"a": 0.5, "b": 0.3, "": 0.2}
    rows = sorted((r.place, r.source, r.block, r.doc_id) for r in mixing.mix_sources(df, weights=w, block_rows=10).collect())
    assert len(rows) == 5000 == len({r[0] for r in rows}) == len({r[3] for r in rows})
    order = [s for _, s, _, _ in rows][:2000]
    for k, share in w.items():
        assert all(abs(order[: n * 10].count(k) / 10 - share * n) < 1 + 4096 / 1e3 * 0.01 for n in range(1, 200))
    with pytest.raises(ValueError):
        mixing.mix_sources(df, weights={"a": 1.0})
    kept = mixing.mix_sources(df, keep_columns=True)
    assert kept.columns == [*df.columns, "place"] and kept.count() == 5000


def test_mixture_keeps_to_the_target_weights(spark):
    # 20,000 blocks of 200 sources, one of them with a third of the rows
    from fractions import Fraction

    n = 20_000
    source = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 199).cast("string")))
    rows = mixing.mix_sources(spark.range(n).select(F.col("id").alias("doc_id"), source.alias("source")), block_rows=1).collect()
    assert len({r.doc_id for r in rows}) == n == len({r.place for r in rows})
    weights = {k: Fraction(c**0.5) for k, c in Counter(r.source for r in rows).items()}
    total = sum(weights.values())
    for r in rows:
        w = weights[r.source] / total
        assert r.block // w <= r.slot < -(-(r.block + 1) // w)
    # explicit weights of 1,000 sources, many times 4,096 slots, and a weight whose slots would pass 2**63
    slots = defaultdict(list)
    exact = mixing.integers([0.33] + [0.67 / 999] * 999)
    for i, slot in mixing.assigned(exact, [9000] + [20] * 999):
        slots[i].append(slot)
    for i, found in slots.items():
        assert all(j * sum(exact) // exact[i] <= t < -(-(j + 1) * sum(exact) // exact[i]) for j, t in enumerate(found))
    last = list(mixing.assigned(mixing.integers([1.0, 1e-300]), [3, 3]))
    assert len({t for _, t in last}) == 6 and max(t for _, t in last) < 1 << 41


# --- tokens


def reference(name, texts):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def odd_texts():
    r = random.Random(9)
    bits = list("abcSTxyz ÄéßΣİıﬁ’ 12٣ \t\n\r\x0b\x1c\x85\xa0 ́日本😀_-!") + ["'s", "'LL", "<|endoftext|>", "  ", "aaaa", "<|startoftext|>"]
    return ["".join(r.choices(bits, k=r.randint(0, 40))) for _ in range(1500)] + ["a" * n for n in range(1, 40)] + ["ab" * 500]


def test_token_counts(spark, docs):
    texts = dict(enumerate([*docs.values(), *odd_texts()]))
    want = reference("word_bpe_49k.json", texts.values())
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = collect(tokens.count_tokens(df, public_tokenizers.path("word_bpe_49k.json"), limit=100))
    for i, t in texts.items():
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (len(want[i]), len((t or "").encode()), len(want[i]) > 100), repr(t)


def test_slices_are_bounded_by_bytes():
    texts = [None, "", "x" * 50, "y" * 500, "z", "é" * 20, None] * 3
    b = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["i", "t"])
    cut = [p.column(1).to_pylist() for p in slices(iter([b]), 4, 100)]
    assert sum(cut, []) == texts
    assert all(len(p) <= 4 and (len(p) == 1 or sum(len((t or "").encode()) for t in p) <= 100) for p in cut)


def test_ids_are_those_of_the_library():
    points = [c for c in range(0, 0x110000, 7) if not 0xD800 <= c < 0xE000] + list(range(0x3000))
    texts = [*odd_texts(), *("a{0}1{0} {0} b{0}{0}Σ".format(chr(c)) for c in points if not 0xD800 <= c < 0xE000), " " * 3000, "a" * 5000, "\0a b\0"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        enc = encode.loaded(public_tokenizers.path(name))
        assert enc.fast is not None
        want = reference(name, texts)
        assert all(np.frombuffer(x, "<u4").tolist() == y for x, y in zip(enc.encode([t.encode() for t in texts]), want, strict=True))
    bpe = tokens.loaded(public_tokenizers.path("word_bpe_49k.json"))
    assert bpe.counts([t.encode() for t in texts]) == [len(x) for x in want]


def test_packing(spark, docs):
    texts = dict(enumerate([*docs.values(), *odd_texts()]))
    ids = [x + [2] for x in reference("byte_bpe_50k.json", texts.values())]
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = packing.pack(df, public_tokenizers.path("byte_bpe_50k.json")).collect()
    by, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert r.ids_crc32 == zlib.crc32(part.tobytes()) and 0 < r.length <= 1024
    for i, x in enumerate(ids):
        p = sorted(by[i], key=lambda r: r.piece)
        assert [r.piece for r in p] == list(range(len(p))) and sum(r.length for r in p) == len(x)
        assert [r.start for r in p] == [sum(q.length for q in p[:k]) for k in range(len(p))] and all(r.length == 1024 for r in p[1:])
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= sum(map(len, ids)) / 1024 * 1.05 + 2


def test_sum_of_squares_choice():
    p = packing.SumOfSquares(10)
    r = random.Random(0)
    for _ in range(400):
        size, n = r.randint(1, 10), p.open.copy()
        squares = lambda x: int((x[1:10] ** 2).sum())
        options = {}
        for g in [*range(size, 10), 10]:
            if g == 10 or n[g] > 0:
                m = n.copy()
                m[g] -= g < 10
                m[g - size] += 1
                options[g] = squares(m)
        before = p.open.copy()
        p.place(size)
        after = p.open.copy()
        after[0] = before[0] = 0
        assert squares(after) == min(options.values())


@pytest.mark.parametrize("size", [1, 7, 300])
def test_token_files(spark, docs, size, monkeypatch):
    texts = {i - 3: t for i, t in docs.items()} | {5000 + i: t for i, t in enumerate(odd_texts()[:200])}
    ids = dict(zip(texts, ([*x, 1] for x in reference("word_bpe_49k.json", texts.values())), strict=True))
    monkeypatch.setattr(tokenfile, "HELD_IDS", 50 * size)
    path = fresh_path(spark, "tokens")
    tokenfile.write_tokens(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3), path, public_tokenizers.path("word_bpe_49k.json"))
    start = 0
    got = collect(tokenfile.read_tokens(spark, path))
    whole = collect(tokenfile.read_tokens(spark, path, digest=False))
    for i in sorted(ids):
        data = np.array(ids[i], "<u4").tobytes()
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids[i]), zlib.crc32(data)) and whole[i].ids == ids[i]
        start += len(ids[i])


def test_coder_round_trip_and_damage():
    rng = np.random.default_rng(1)
    blocks = [rng.integers(0, 65536, n).astype(np.uint32) for n in (0, 1, 2, 700, 33)] + [np.tile(np.arange(50, dtype=np.uint32) * 900, 60), np.full(900, 65535, np.uint32)]
    coded = rangecoder.encode_blocks(blocks)
    for a, b in zip(blocks, rangecoder.decode_blocks(coded), strict=True):
        assert np.array_equal(a, b)
    # a block is the same alone as among others, and decodes alone
    assert rangecoder.encode_blocks([blocks[3]])[0] == coded[3] and np.array_equal(rangecoder.decode_blocks([coded[5]])[0], blocks[5])
    assert len(coded[5]) < 2 * len(blocks[5]) / 4
    for at in (0, 9, len(coded[3]) - 1):
        broken = bytearray(coded[3])
        broken[at] ^= 1
        with pytest.raises(ValueError):
            rangecoder.decode_blocks([bytes(broken)])
    wide = [np.array([65536, 3, 0xFFFFFFFF, 70000, 3], np.uint32), np.zeros(0, np.uint32)]
    assert all(np.array_equal(a, b) for a, b in zip(wide, rangecoder.decode_blocks(rangecoder.encode_blocks(wide)), strict=True))


def test_coder_survives_short_intervals(monkeypatch):
    # intervals that straddle a multiple of 2**48 and are too short to divide, on both sides of it
    seam = 5 << 48
    states = [(seam - 3, seam + 4), (seam - 1, seam), (seam - (1 << 20), seam + 2), (seam - 2, seam + (1 << 31)), (7, (1 << 64) - 1), (seam, seam + (1 << 33))]

    class Cornered(rangecoder.Lanes):
        def __init__(self, n):
            super().__init__(n)
            self.x1[:] = np.array([states[i % len(states)][0] for i in range(n)], np.uint64)
            self.x2[:] = np.array([states[i % len(states)][1] for i in range(n)], np.uint64)
            while len(at := self.short(n)):
                assert ((self.x1[at] ^ self.x2[at]) >> np.uint64(48) == 0).all()
                self.shift(at)
            assert (self.x1 < self.x2).all()

    monkeypatch.setattr(rangecoder, "Lanes", Cornered)
    rng = np.random.default_rng(2)
    blocks = [rng.integers(0, 60000, 40).astype(np.uint32) for _ in range(12)]
    assert all(np.array_equal(a, b) for a, b in zip(blocks, rangecoder.decode_blocks(rangecoder.encode_blocks(blocks)), strict=True))


# --- language


def test_language_id(spark):
    r = random.Random(8)
    sounds = {"aa": ["ba", "da", "ga"], "bb": ["strin", "gloth", "menk"], "cc": ["ouè", "ille", "éau"]}
    say = lambda k: " ".join("".join(r.choices(sounds[k], k=3)) for _ in range(r.randint(5, 60)))
    rows = [(i, say(k), k) for i in range(900) for k in ["aabbcc"[i % 3 * 2 :][:2]]]
    df = spark.createDataFrame([*rows, (901, None, "aa"), (902, "12 !?", "aa"), (903, "q", None), (904, "", "bb")], "doc_id long, text string, lang string")
    held = langid.held_out(F.col("doc_id"))
    out = collect(langid.identify(df, langid.fit(df.filter(~held))))
    test = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(test) > 200 and all(out[i].lang_pred == rows[i][2] for i in test)
    assert [out[i].lang_pred for i in (901, 902, 904)] == ["und"] * 3 and out[903].lang_pred in sounds and out[903].score == 0
    assert all(0 <= r.score <= 1 for r in out.values())
    kept = langid.keep_identified(df, langid.fit(df))
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == list(range(900))


def test_many_languages_use_several_mask_words():
    langs = [f"l{k:03}" for k in range(70)]
    grams = {lang: langid.ngrams(next(langid.blocks(lang * 3 + chr(0x4E00 + k) * 9))[0]).view(np.int64).tolist() for k, lang in enumerate(langs)}
    m = langid.Model.of(langs, grams, "l000")
    assert m.masks.shape[0] == 2 and m.predict([chr(0x4E00 + 66) * 20])[0][0] == "l066"


def test_blocks_of_a_long_text_have_the_ngrams_of_the_whole(monkeypatch):
    r = random.Random(12)
    for _ in range(60):
        text = "".join(r.choices("abÀΣσß .,1\n語", k=r.randint(0, 90)))
        monkeypatch.setattr(langid, "BLOCK_CHARS", 1 << 19)
        whole = [langid.ngrams(c).tolist() for c, _ in langid.blocks(text)]
        assert len(whole) == 1
        for size in (1, 2, 7, 30):
            monkeypatch.setattr(langid, "BLOCK_CHARS", size)
            assert sum((langid.ngrams(c).tolist() for c, _ in langid.blocks(text)), []) == whole[0]
    plain = lambda t: re.sub(r"[\W\d_]+", " ", f" {t} ".lower())
    monkeypatch.setattr(langid, "BLOCK_CHARS", 5)
    text = "One, two; THREE 4 five -- déjà vu"
    want = [plain(text)[k : k + 4] for k in range(len(plain(text)) - 3)]
    assert sum(len(langid.ngrams(c)) for c, _ in langid.blocks(text)) == len(want)


def test_filters_against_exact_sets_of_ngrams():
    r = random.Random(14)
    words = {lang: ["".join(r.choices(letters, k=r.randint(3, 8))) for _ in range(400)] for lang, letters in {"p": "abcdefgh", "q": "efghijkl", "r": "ijklmnop"}.items()}
    say = lambda lang, n: " ".join(r.choices(words[lang], k=n))
    grams = {lang: {g for _ in range(40) for c, _ in langid.blocks(say(lang, 60)) for g in langid.ngrams(c).tolist()} for lang in words}
    m = langid.Model.of(sorted(words), {k: np.array(sorted(v), np.uint64).view(np.int64).tolist() for k, v in grams.items()}, "p")
    for lang in [*words] * 20:
        text = say(lang, r.randint(1, 50))
        own = [g for c, _ in langid.blocks(text) for g in langid.ngrams(c).tolist()]
        exact = {k: sum(g in v for g in own) / len(own) for k, v in grams.items()}
        found, score = m.predict([text])[0]
        assert exact[found] == max(exact.values()) and abs(score - exact[found]) < 0.03


def test_places_follow_a_plain_schedule(spark):
    # every slot from the definition: the released block with the earliest deadline, by exact fractions
    from fractions import Fraction

    counts = {"a": 70, "b": 31, "c": 9, "": 1}
    rows = [(k * 1000 + n, s or None) for k, (s, c) in enumerate(counts.items()) for n in range(c)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, source string"), block_rows=4).collect()
    weight = {s: Fraction(c**0.5) for s, c in counts.items()}
    total = sum(weight.values())
    left = {s: -(-c // 4) for s, c in counts.items()}
    done, want, slot = dict.fromkeys(counts, 0), {}, 0
    while any(done[s] < left[s] for s in counts):
        ready = [(-(-(done[s] + 1) * total // weight[s]), s) for s in sorted(counts) if done[s] < left[s] and done[s] * total // weight[s] <= slot]
        if ready:
            s = min(ready)[1]
            want[s, done[s]] = slot
            done[s] += 1
        slot += 1
    assert {(r.source, r.block): r.slot for r in got} == want
    for s, c in counts.items():
        mine = sorted((r for r in got if r.source == s), key=lambda r: r.place)
        assert [r.place for r in mine] == [want[s, n // 4] * 4 + n % 4 for n in range(c)]
        assert Counter(r.block for r in mine) == Counter(n // 4 for n in range(c))


def test_mixture_keeps_columns_that_clash(spark):
    names = ["doc_id", "source", "_hash", "_source", "_group", "_rank", "_block", "_slot", "_row", "_tie", "_chunk", "n", "text"]
    rows = [tuple(f"{c}{i}" if c not in ("doc_id", "source") else ("ab"[i % 2] if c == "source" else i // 3) for c in names) for i in range(40)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} {'long' if c == 'doc_id' else 'string'}" for c in names))
    kept = mixing.mix_sources(df, keep_columns=True, block_rows=4)
    assert kept.columns == [*names, "place"]
    assert sorted(tuple(r)[:-1] for r in kept.collect()) == sorted(rows) and len({r.place for r in kept.collect()}) == 40
    again = mixing.mix_sources(df.repartition(5), keep_columns=True, block_rows=4)
    assert {tuple(r) for r in kept.collect()} == {tuple(r) for r in again.collect()}


def test_roles_with_every_control_come_back(spark):
    bits = ["\r", "\n", "\\", "n", "\\n", "r\\", "<|im_end|>", "<\\|im_end|>", "[INST]", "</s>", " ", "\r\\"]
    r = random.Random(16)
    roles = ["".join(r.choices(bits, k=r.randint(0, 6))) for _ in range(400)]
    df = spark.createDataFrame([(i, 0, x, x + "!") for i, x in enumerate(roles)], "conv_id long, turn int, role string, text string")
    got = {x.conv_id: x.turns for x in chat.read_back(chat.format_chat(chat.canonical_turns(df))).collect()}
    assert all(got[i][0].role == x and got[i][0].text == x + "!" for i, x in enumerate(roles))


def test_chunks_keep_their_ids(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [*odd_texts()[:300], "H̱ ẖ İ Σας ΣΑΣ", "<|ENDOFTEXT|> <|endoftext|>x a\0b", "\n\t́ x͸y " + "w" * 300, "One two One TWO's"]
    raw, want = [t.encode() for t in texts], [np.array(x, "<u4").tobytes() for x in reference("word_bpe_49k.json", texts)]
    enc = encode.Encoder(path)
    assert enc.encode(raw) == want and enc.encode(raw[::-1]) == want[::-1]
    short = [b"One two", b"two one", b""]
    first = enc.encode(short)
    monkeypatch.setattr(enc, "fast", object())
    assert enc.encode(short) == first
    monkeypatch.undo()
    monkeypatch.setattr(encode, "CACHE_ENTRIES", 3)
    assert [enc.encode([t])[0] for t in raw] == want


def test_coder_stores_the_frequencies_of_a_block():
    rng = np.random.default_rng(3)
    skewed = (rng.geometric(0.02, 4000) % 700 * 61).astype(np.uint32)
    whole = np.arange(1 << 16, dtype=np.uint32)
    coded = rangecoder.encode_blocks([skewed, whole])
    # learning the frequencies as coding goes took 4,644 bytes
    assert len(coded[0]) < 4200
    assert all(np.array_equal(a, b) for a, b in zip([skewed, whole], rangecoder.decode_blocks(coded), strict=True))


def test_chunks_are_looked_up_once():
    class Counted(dict):
        looked = 0

        def get(self, key, default=None):
            self.looked += 1
            return super().get(key, default)

    class Pattern:
        def __init__(self, pattern):
            self.pattern, self.cut = pattern, []

        def findall(self, text):
            self.cut += text.split("\n")
            return self.pattern.findall(text)

    texts = ["Word élan two's 1999 word\x1c " * 50, "", " \x0b two word\tword 中文 ", "word"] * 3
    want = [np.array(x, "<u4").tobytes() for x in reference("word_bpe_49k.json", texts)]
    enc = encode.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    enc.cache, enc.pattern = Counted(), Pattern(enc.pattern)
    assert enc.encode([t.encode() for t in texts]) == want
    distinct = {c for t in texts for c in t.encode().split()}
    # each chunk occurs many times; one of letters alone is not cut
    assert enc.cache.looked <= 3 * len(distinct) + 1
    assert enc.pattern.cut and not any(map(str.isalpha, enc.pattern.cut))


def test_coder_numbers_the_ids_of_a_block():
    cycle = np.tile(np.random.default_rng(5).permutation(60000)[:1000].astype(np.uint32), 8)
    # a symbol has a context of its own, and entries are narrow unless a block has many symbols
    lanes = rangecoder.Lanes(2)
    for n, size in ((4096, 2), (4097, 4)):
        lanes.hold(n)
        assert lanes.table.itemsize == size
    symbols = np.arange(2, dtype=np.int64)
    at = {int(lanes.predict(2, symbols + 2 * i, symbols)[2][0][0, 0]) for i in range(500)}
    assert len(at) == 500
    # entries of 16 bits and of 32, by the block with most distinct ids
    for n in (1, 4096, 4097):
        blocks = [np.tile(np.arange(n, dtype=np.uint32) * 11, 3), cycle[:50]]
        coded = rangecoder.encode_blocks(blocks)
        assert all(np.array_equal(a, b) for a, b in zip(blocks, rangecoder.decode_blocks(coded), strict=True))
        # the same block alone has narrower entries, but the same code
        assert rangecoder.encode_blocks(blocks[1:]) == coded[1:]


def test_ids_of_chunks_lie_in_one_array(monkeypatch):
    texts = ["one two two's <|endoftext|> three", "", "three élan ͸ two " + "w" * 300, "H̱ two"]
    want = [np.array(x, "<u4").tobytes() for x in reference("word_bpe_49k.json", texts)]
    enc = encode.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert enc.encode([t.encode() for t in texts]) == want and enc.encode([]) == [] and enc.encode([b" ", b""]) == [b"", b""]
    for chunk, number in enc.cache.items():
        start, end = enc.ends[number : number + 2].tolist()
        assert enc.ids[start // 4 : end // 4].tolist() == reference("word_bpe_49k.json", [chunk.decode()])[0]
    # neither chunks nor ids are kept without bound
    monkeypatch.setattr(encode, "CACHE_IDS", 5)
    for _ in range(3):
        assert [enc.encode([t.encode()])[0] for t in texts] == want
    assert enc.ends[enc.count] < 4 * 400


def test_short_document_tables_are_plain():
    for ids in ([], [None], [-5, 7, None], list(range(-300, 300))):
        sizes = [abs(i or 3) % 9 for i in ids]
        packed = tokenfile.pack_table(ids, sizes)
        assert tokenfile.unpack_table(packed + b"rest") == (ids, sizes, b"rest")
        # short ones plain, long ones compressed
        assert (len(packed) == tokenfile.TABLE.size + 17 * len(ids)) == (len(ids) < 9)
        if ids:
            broken = bytearray(packed)
            broken[-1] ^= 1
            with pytest.raises(ValueError):
                tokenfile.unpack_table(bytes(broken))
