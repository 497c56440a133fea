"""Operators against brute force on small tables."""

import json
import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from basalt.llm import _graph, chat_format, lm_score, mixing, ngram_join, sentencepieces, suffix_dedup, toxicity
from basalt.llm._graph import components
from basalt.llm.queries import QUERIES, TOKENIZERS

from . import brute

PIECES = f"{TOKENIZERS}/piece_bpe_32k.model"
CODEC = sentencepieces.Codec(sentencepieces.load(PIECES))
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


# suffix arrays


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=80) | st.text("ab", max_size=80).map(str.encode) | st.binary(max_size=6).map(lambda b: b * 30))
def test_suffix_array_and_prefixes(b):
    data = np.frombuffer(b, np.uint8)
    want = sorted(range(len(b)), key=lambda i: b[i:])
    sa = suffix_dedup.suffix_array(data)
    assert sa.tolist() == want
    lengths = suffix_dedup.common_prefixes(data, sa).tolist()
    for k in range(1, len(b)):
        x, y = b[want[k] :], b[want[k - 1] :]
        assert lengths[k] == next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))


@pytest.mark.parametrize("length", [40, 100])
def test_repeats(docs, texts, length, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SHARD", 40_000)
    monkeypatch.setattr(suffix_dedup, "PART", 30_000)
    got = suffix_dedup.remove_repeats(docs.repartition(5), length).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute.repeats(texts, length)


def test_repeats_that_overlap_and_recur(spark):
    r = random.Random(4)
    base = "".join(r.choice("abcdefgh ") for _ in range(600))
    rows = [(k, "".join(base[(a := r.randrange(500)) : a + r.randrange(60, 300)] + r.choice("xyz") for _ in range(6))) for k in range(60)]
    rows += [(100, "ab" * 400), (101, "ab" * 120), (102, "a" * 500)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute.repeats(rows, 100)


def test_repeats_of_texts_that_share_an_id(spark):
    """Different texts of one id, or of none, are searched and cut each by its own ranges."""
    r = random.Random(5)
    base = "".join(r.choice("abcdefgh ") for _ in range(400))
    text = lambda: "".join(base[(a := r.randrange(300)) : a + r.randrange(60, 250)] + r.choice("xyz") for _ in range(4))
    rows = [(i, text()) for i in (None, None, None, 3, 3, 4, 7, 7, 9)]
    table = spark.createDataFrame([*rows, rows[4]], "doc_id long, text string")
    by = table.distinct().orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).collect()
    want = brute.repeats([(k, x.text) for k, x in enumerate(by)], 100)
    got = suffix_dedup.remove_repeats(table.repartition(3)).collect()
    again = next(k for k, x in enumerate(by) if (x.doc_id, x.text) == rows[4])
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted((by[k].doc_id or 0, *want[k]) for k in [*want, again])


# near duplicates


@pytest.mark.parametrize(("size", "num", "block"), [(3, 90, 512), (5, 80, 512), (3, 60, 4), (3, 90, 2)])
def test_near_components(docs, texts, size, num, block, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_components(docs, size, num, 100).collect()}
    assert got == brute.near(texts, size, num, 100)


def test_near_chains(spark):
    """Copies that drift: neighbours link, ends do not."""
    r = random.Random(2)
    words, rows = [f"w{k}" for k in range(120)], []
    for k in range(120):
        words[r.randrange(120)] = f"n{k}"
        rows.append((k * 3, " ".join(words)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()}
    assert got == brute.near(rows, 3, 90, 100)


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(x, x) == root(x) for x in parent)


def some_links():
    """Links of pairs of numbers: stars, a chain in no order, a ring, loops and doubles; and each node's smallest."""
    r = random.Random(3)
    chain = r.sample(range(1000, 1400), 400)
    links = [(0, k) for k in range(1, 60)] + [(999, k) for k in range(70, 130)] + list(zip(chain, chain[1:], strict=False)) + [(k, 2000 + (k + 1) % 50) for k in range(2000, 2050)]
    links = [((-1, a), (-1, b)) for a, b in links * 2] + [((7, 5), (-1, 65)), ((7, 5), (2, 9)), ((3, 3), (3, 3))]
    r.shuffle(links)
    nodes = sorted({x for ab in links if ab[0] != ab[1] for x in ab})
    at = {x: k for k, x in enumerate(nodes)}
    least = list(range(len(nodes)))
    for _ in nodes:
        was = list(least)
        for a, b in links:
            if a != b:
                least[at[a]] = least[at[b]] = min(least[at[a]], least[at[b]])
        if was == least:
            break
    return links, {x: nodes[least[k]] for x, k in at.items()}


@pytest.mark.parametrize("most", [1 << 18, 0])
@pytest.mark.parametrize("tasks", [1, 7])
def test_components_of_structs(spark, monkeypatch, most, tasks):
    """In one task where links are few, by rounds where they aren't: the same, and nodes come once."""
    monkeypatch.setattr(_graph, "TASK", most)
    links, want = some_links()
    kind = "struct<window: long, doc_id: long>"
    rows = components(spark.createDataFrame(links, f"a {kind}, b {kind}").repartition(tasks)).collect()
    assert {tuple(r.node): tuple(r.component) for r in rows} == want and len(rows) == len(want)
    assert components(spark.createDataFrame([], f"a {kind}, b {kind}")).count() == 0


def test_few_links_need_no_rounds(spark):
    """However long a chain: each round was a dozen shuffles, whose files waited for the driver's collector."""
    sc, r = spark.sparkContext, random.Random(4)
    chain = r.sample(range(3000), 3000)
    links = spark.createDataFrame(list(zip(chain, chain[1:], strict=False)), "a long, b long").repartition(5).cache()
    assert links.count() == 2999
    sc.setJobGroup("few-links", "components of few links")
    try:
        found = components(links)
    finally:
        sc._jsc.clearJobGroup()
    track = sc.statusTracker()
    stages = {s for j in track.getJobIdsForGroup("few-links") for s in track.getJobInfo(j).stageIds}
    assert {r.component for r in found.collect()} == {0} and found.count() == 3000
    assert 1 <= len(stages) <= 8


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=60))
def test_least_reachable(links):
    a, b = (np.array([x[k] for x in links], np.int64) for k in (0, 1))
    want = list(range(31))
    for _ in want:
        for p, q in links:
            want[p] = want[q] = min(want[p], want[q])
    assert _graph.least_reachable(a, b, 31).tolist() == want


# pieces


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text("ab ▁\n\tthe<>é漢😀", max_size=60))
def test_pieces_equal_the_library(text):
    ids = CODEC.encode(text)
    assert ids.tolist() == LIBRARY.encode(text)
    assert CODEC.decode(ids) == LIBRARY.decode(ids.tolist())


def test_stream_commits_within_a_window():
    search = sentencepieces.Viterbi(CODEC.v)
    text, out, widest = "supercalifragilistic" * 300, [], 0
    for at in range(0, len(text), 16):
        search.push(text[at : at + 16])
        out += search.commit()
        widest = max(widest, len(search.text))
    out += search.finish()
    assert widest < 200
    assert "".join(CODEC.v.names[i] for i in out) == text


def test_unigram_viterbi():
    """A model of scores: the best sum wins, unknown characters cost most."""

    def piece(name, score, kind=1):
        body = b"\x0a" + bytes([len(name.encode())]) + name.encode() + b"\x15" + np.float32(score).tobytes() + b"\x18" + bytes([kind])
        return b"\x0a" + bytes([len(body)]) + body

    flags = b"\x1a\x04\x18\x00\x20\x00"
    raw = piece("<unk>", 0, 2) + b"".join(piece(n, s) for n, s in (("a", -2.0), ("b", -2.0), ("ab", -3.0), ("aba", -6.5), ("bab", -3.5))) + b"\x12\x02\x18\x01" + flags
    codec = sentencepieces.Codec(raw)
    assert [codec.v.names[i] for i in codec.encode("abab")] == ["a", "bab"]
    assert codec.encode("azzb").tolist() == [1, 0, 2]


# chat


def test_template_is_reversible(spark):
    """What format_chat writes gives back every role and text, and the loss mask the assistant's alone."""
    r = np.random.default_rng(8)
    bits = ["a", "<", "&", "&lt;", "&amp;", "</turn>\n", "<turn>user<says>\n", "\\", "#", "\n", ";lt", "é", "𝄞"]
    turns = {c: [(str(r.choice(["user", "assistant", "a<b&", ""])), "".join(r.choice(bits, r.integers(0, 9)))) for _ in range(r.integers(1, 5))] for c in range(150)}
    rows = [(c, k, role, text) for c, said in turns.items() for k, (role, text) in enumerate(said)]
    made = chat_format.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    roles, texts = chat_format.read_back(F.col("formatted"))
    got = {x.conv_id: x for x in made.select("conv_id", roles.alias("roles"), texts.alias("texts"), "formatted", "loss_spans", chat_format.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    unescape = lambda t: t.replace("&lt;", "<").replace("&amp;", "&")
    for c, said in turns.items():
        assert list(zip(got[c].roles, got[c].texts)) == said
        learned = [t for role, t in said if role == "assistant"]
        assert got[c].loss == "".join(learned)
        assert [unescape(got[c].formatted[s.start : s.start + s.length]) for s in got[c].loss_spans] == learned


def test_the_fingerprint_of_a_table_picks_its_mapping(spark):
    turns = lambda df: [tuple(r) for r in chat_format.canonical_turns(df).orderBy("conv_id", "turn").collect()]
    plain = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id long, turn int, role string, text string")
    want = [(1, 0, "user", "a"), (1, 1, "assistant", "b")]
    assert chat_format.pick(plain.schema).name == "turn rows" and turns(plain) == want
    assert turns(plain.withColumn("piece", F.lit(1)).withColumn("prompt", F.lit(2))) == want
    assert turns(plain.toDF("conversation_id", "turn_index", "role", "content")) == want
    lists = spark.createDataFrame([(1, [("human", "a"), ("gpt", "b")])], "conv_id long, conversations array<struct<`from`:string,value:string>>")
    assert turns(lists) == want
    pairs = spark.createDataFrame([(1, "a", "", "b")], "conv_id long, instruction string, input string, output string")
    assert chat_format.pick(pairs.schema).name == "instruction and input" and turns(pairs) == want
    with pytest.raises(ValueError, match="layout"):
        chat_format.canonical_turns(plain.select("conv_id", "text"))


def test_layouts(spark):
    records = [
        {"messages": [{"role": "user", "content": "a<b"}, {"role": "assistant", "content": "c"}]}, {"instruction": "do", "input": "", "output": "ok"},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "r"}]}, {"prompt": "p", "completion": None}, [{"role": "system", "content": "s"}], {"odd": 1},
    ]
    df = spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(records)] + [(9, "{"), (10, None)], "conv_id long, record string")
    got = {}
    for r in chat_format.canonical_turns(df).orderBy("conv_id", "turn").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == {0: [("user", "a<b"), ("assistant", "c")], 1: [("user", "do"), ("assistant", "ok")], 2: [("user", "q"), ("assistant", "r")], 3: [("user", "p"), ("assistant", "")], 4: [("system", "s")]}
    assert {(r.layout is None, r.n) for r in chat_format.unknown_layouts(df).collect()} == {(False, 1), (True, 2)}


# toxicity


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-5, 5).filter(bool), max_size=24))
def test_maximal_segments(scores):
    """Against the definition: the best segment, then the same left and right of it."""

    def split(a, b):
        best = max(((sum(scores[i:j]), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
        if best[0] <= 0:
            return []
        _, _, _, i, j = best
        return [*split(a, i), (i, j - 1, float(best[0])), *split(j, b)]

    got = [(a, b, s) for _, a, b, s in toxicity.segments(np.zeros(len(scores), int), np.array(scores, float))]
    assert sorted(s for *_, s in got) == pytest.approx(sorted(s for *_, s in split(0, len(scores))))
    assert all(sum(scores[a : b + 1]) == pytest.approx(s) for a, b, s in got)
    assert all(one[1] < two[0] for one, two in zip(got, got[1:], strict=False))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.floats(-5, 5).filter(bool), max_size=24, unique_by=abs))
def test_places_of_maximal_segments(scores):
    want = [(a, b) for a, b, _ in brute.segments(scores)]
    got = [(a, b) for _, a, b, _ in toxicity.segments(np.zeros(len(scores), int), np.array(scores))]
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    apart = np.abs(sums[:, None] - sums[None, :])[np.triu_indices(len(sums), 1)]
    if not len(apart) or apart.min() > 1e-6:  # without ties there is one answer
        assert got == sorted(want)


def test_toxicity_of_each_text_alone(spark, small, texts):
    """The query over batches against one text at a time, its passages found by the definition."""
    import math

    from basalt.llm._spark import text_bytes
    from basalt.llm._tokens import OTHER, Tokens

    read = lambda name: spark.read.parquet(f"{small}/{name}.parquet")
    model = toxicity.learn(read("documents"), read("labels"), "toxic")
    got = {r.doc_id: r for r in QUERIES["op9_toxicity"](spark, small).collect()}
    assert len(got) == len(texts)
    lam, k = model.law
    a, b = model.curve
    for d, text in texts:
        scores = model.score_tokens(Tokens(*text_bytes(pa.array([text or ""])), OTHER, latin=True)).tolist()
        found = brute.segments(scores)
        evidence = math.log1p(sum(1 / max(k * len(scores) * math.exp(-lam * x), 1e-200) for *_, x in found))
        assert got[d].score == pytest.approx(1 / (1 + math.exp(-(a + b * evidence))), rel=1e-6)
        assert got[d].n_passages == len(found) and got[d].predicted == (got[d].score >= 0.3)


def test_held_out_toxicity(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op9_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out")
    assert rows.filter("predicted = toxic").count() >= 0.95 * rows.count()


def test_held_out_language(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op10_language_id"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out")
    assert rows.filter("lang_pred = lang").count() >= 0.97 * rows.count()


def test_rare_languages_are_learned(spark):
    from basalt.llm import language_id

    rows = [(k, "aa", f"the cat sat on the mat {k}") for k in range(6000)] + [(k, "bb", f"zwölf boxkämpfer jagen viktor {k}") for k in range(6000, 6012)]
    table = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = language_id.learn(table, sample_rows=300)
    assert model.langs == ["aa", "bb"]
    told = language_id.identify(table.filter("doc_id >= 6000"), model).select("lang_pred").distinct().collect()
    assert [r.lang_pred for r in told] == ["bb"]


def test_language_of_each_text_alone(spark, small, texts):
    """The query against trigrams counted plainly and the cosine to every centroid in double precision."""
    from basalt.llm import language_id

    model = language_id.learn(spark.read.parquet(f"{small}/documents.parquet"))
    got = {r.doc_id: r for r in QUERIES["op10_language_id"](spark, small).collect()}
    assert len(got) == len(texts)
    centroids, idf = model.centroids.astype(float), model.idf.astype(float)
    for d, text in texts:
        if not any(c.isalpha() for c in text or ""):
            assert (got[d].lang_pred, got[d].score) == ("und", 0.0)
            continue
        v = np.zeros(language_id.PLACES)
        for place, n in brute.trigrams(text, language_id.PLACES).items():
            v[place] = np.log1p(n) * idf[place]
        cosine = centroids @ (v / max(np.linalg.norm(v), 1e-9))
        assert got[d].score == pytest.approx(float(np.clip(cosine.max(), 0, 1)), abs=1e-4)
        assert got[d].lang_pred in {model.langs[model.of[c]] for c in np.flatnonzero(cosine >= cosine.max() - 1e-4)}


# mixing


def test_shares_of_the_query(spark):
    """Expected tokens of the domains, summed plainly from the rates that the query gives."""
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op1_mixing"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.rate >= 0 and sum(r.posterior) == pytest.approx(1, abs=1e-5) for r in rows)
    share = np.sum([np.array(r.posterior) * r.n_tokens * r.rate for r in rows], 0)
    assert sorted(share / share.sum()) == pytest.approx([0.04, 0.08, 0.18, 0.7], abs=2e-3)


def test_rates_meet_targets(spark):
    r = np.random.default_rng(1)
    p = r.dirichlet([0.3, 0.3, 0.3], 400)
    rows = [(int(k), int(n), [float(x) for x in v]) for k, (n, v) in enumerate(zip(r.integers(1, 500, 400), p))]
    soft = spark.createDataFrame(rows, "doc_id long, n_tokens long, posterior array<double>")
    steps = mixing.fit_rates(soft, ["a", "b", "c"], {"a": 0.6, "b": 0.3, "c": 0.1})
    got = mixing.rates(soft, steps).toPandas()
    n = got.n_tokens.to_numpy() * got.rate.to_numpy()
    share = n @ np.stack(got.posterior) / got.n_tokens.sum()
    assert np.abs(share - [0.6, 0.3, 0.1]).max() < 1e-3 and (got.rate >= 0).all()


# language model


def test_probabilities_sum_to_one():
    model = lm_score.Attention()
    model.ready()
    h = np.random.default_rng(0).normal(size=(1, lm_score.SIZE)).astype(np.float32)
    every = np.arange(lm_score.VOCAB)
    assert np.exp(model.next_log(np.repeat(h, len(every), 0), every)).sum() == pytest.approx(1, abs=1e-3)


def test_each_subword_is_scored_once_and_causally():
    model, r = lm_score.Attention(), np.random.default_rng(1)
    model.ready()
    y = r.integers(0, lm_score.VOCAB, 101).astype(np.uint16)
    x = np.concatenate([[lm_score.END], y[:-1]]).astype(np.uint16)
    row = np.repeat([0, 1], [40, 61])
    whole = model.score(x, y, row)
    assert len(whole) == len(y)
    z = y.copy()
    z[70:] = r.integers(0, lm_score.VOCAB, 31)
    later = model.score(np.concatenate([[lm_score.END], z[:-1]]).astype(np.uint16), z, row)
    assert np.allclose(whole[:70], later[:70], atol=1e-5)
    w = y.copy()
    w[:39] = r.integers(0, lm_score.VOCAB, 39)
    other = model.score(np.concatenate([[lm_score.END], w[:-1]]).astype(np.uint16), w, row)
    assert np.allclose(whole[41:], other[41:], atol=1e-5)


def test_how_far_a_subword_sees():
    """The last place of a window knows 31 subwords before its own, the first 8."""
    model, r = lm_score.Attention(), np.random.default_rng(4)
    model.w = {k: v * 3 for k, v in model.w.items()}
    model.ready()
    y, row = r.integers(0, lm_score.VOCAB, 96).astype(np.uint16), np.zeros(96, int)
    x = np.concatenate([[lm_score.END], y[:-1]]).astype(np.uint16)
    whole, reach = model.score(x, y, row), np.zeros(96, int)
    for k in range(96):
        other = x.copy()
        other[k] = (int(x[k]) + 2000) % lm_score.END
        seen = np.flatnonzero(model.score(other, y, row) != whole)
        reach[seen] = np.maximum(reach[seen], seen - k)
    assert reach.max() == 31 and reach[40:].min() >= 8


def test_gradient():
    r = np.random.default_rng(2)
    model = lm_score.Attention()
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    model.ready()
    y = r.integers(0, 50, 120).astype(np.uint16)
    x = np.concatenate([[lm_score.END], y[:-1]]).astype(np.uint16)
    head = lm_score.WIDE - lm_score.STEP
    px, pr, windows = np.concatenate([np.full(head, lm_score.END, np.uint16), x]), np.concatenate([np.full(head, -1), np.zeros(120, int)]), np.array([0, 30, 60])
    g = model._gradient(px, pr, y, windows)

    def loss():
        model.ready()
        h = model.attend(px, pr, windows)[4]
        return -model.next_log(h, y[windows[:, None] + np.arange(lm_score.STEP)].ravel()).mean()

    for name in ("q", "v", "e", "far", "c1", "emb"):
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        kept = model.w[name][at]
        model.w[name][at] = kept + 1e-2
        up = loss()
        model.w[name][at] = kept - 1e-2
        down = loss()
        model.w[name][at] = kept
        assert (up - down) / 2e-2 == pytest.approx(g[name][at], rel=0.05, abs=2e-4)


def test_places_follow_rows_not_their_order():
    r = np.random.default_rng(8)
    hashes = np.concatenate([r.integers(-(1 << 62), 1 << 62, 500), np.full(300, 77), np.full(2, 77 + lm_score.Places.STRIDE), [-1, -1]])
    one = lm_score.Places(3)
    first = np.concatenate([one.of(hashes[:200]), one.of(hashes[200:])])
    by = r.permutation(len(hashes))
    again = lm_score.Places(3).of(hashes[by])
    few = hashes < 0
    assert len(set(first)) == len(hashes) and set(first) == set(again)
    assert {h: set(first[hashes == h]) for h in hashes[few]} == {h: set(again[hashes[by] == h]) for h in hashes[few]}
    assert not set(first) & set(lm_score.Places(4).of(hashes))


def test_attention_learns_from_every_text():
    """Passes over partitions cover each place, and texts that no sample holds move the averaged weights."""
    import pickle

    from basalt.llm._spark import text_bytes
    from basalt.llm.queries import TOKENIZERS

    subwords = lm_score.Subwords(lm_score.load_ranks(f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken"))
    sent = type("Sent", (), {"value": (subwords, lm_score.Attention().w)})
    stream = lambda texts: lm_score.Stream(*text_bytes(pa.array(texts)), subwords)

    def fit(texts, apart=None):
        batches = [pa.record_batch([pa.array(texts[k : k + 50]), pa.array([t == apart for t in texts[k : k + 50]])], ["text", "apart"]) for k in range(0, len(texts), 50)]
        rows = [r for b in lm_score._count(sent, 3, 2)(iter(batches)) for r in b.to_pylist() if r["kind"] == lm_score.WEIGHTS]
        model = lm_score.Attention()
        windows, model.w = lm_score._whole([pickle.loads(r["data"]) for r in rows])
        model.ready()
        return windows, model

    plain, odd = ["the cat sat on the mat and looked at the rain"] * 1000, ["seven green lamps hum under every quiet bridge"] * 1000
    few, many = fit(plain[:500]), fit(plain)
    assert many[0] >= 1.9 * few[0] and many[0] * lm_score.STEP >= len(stream(plain).y)
    s = stream(odd[:20])
    without, within = many[1].score(s.x, s.y, s.row).mean(), fit(plain + odd)[1].score(s.x, s.y, s.row).mean()
    assert within > without + 0.5
    assert fit(["a"])[0] == 1  # shorter than a window
    held = fit(plain + odd[:1], apart=odd[0])[1].score(s.x, s.y, s.row).mean()
    assert held == pytest.approx(without, abs=0.05)  # texts apart move no weight


def test_share_is_fitted_without_the_texts_own_counts():
    """Against the best share of a grid, with pair probabilities of the other texts counted plainly."""
    from collections import Counter

    from basalt.llm._spark import text_bytes

    subwords = lm_score.Subwords(lm_score.load_ranks(f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken"))
    r = random.Random(3)
    lines = [" ".join(r.choice(["the", "cat", "sat", "on", "a", "mat", "green", "lamps"]) for _ in range(r.randrange(3, 30))) for _ in range(60)]
    stream = lambda texts: lm_score.Stream(*text_bytes(pa.array(texts)), subwords)
    others, apart = stream(lines[:45]), stream(lines[45:])
    attention = lm_score.Attention().train(others.x, others.y, others.row, 30)
    whole = stream(lines)
    pairs, counts = np.unique(whole.x.astype(np.int64) * lm_score.VOCAB + whole.y, return_counts=True)
    scorer = lm_score.Scorer(subwords, attention, pairs, counts).fit_share(apart)
    seen = Counter(zip(others.x.tolist(), others.y.tolist()))
    one, before, kinds = Counter(), Counter(), Counter()
    for (x, y), n in seen.items():
        one[y] += n
        before[x] += n
        kinds[x] += 1
    total = sum(one.values()) + 0.5 * lm_score.VOCAB

    def pair(x, y):
        room = (kinds[x] + 1) / (before[x] + kinds[x] + 1)
        return room * (one[y] + 0.5) / total + seen[x, y] / (before[x] + kinds[x] + 1)

    a = np.exp(attention.score(apart.x, apart.y, apart.row).astype(float))
    b = np.array([pair(x, y) for x, y in zip(apart.x.tolist(), apart.y.tolist())])
    grid = np.linspace(0.02, 0.98, 97)
    loss = [-np.log(g * a + (1 - g) * b).mean() for g in grid]
    assert -np.log(scorer.share * a + (1 - scorer.share) * b).mean() <= min(loss) + 0.01
    p = scorer.share * a + (1 - scorer.share) * scorer.pair_probability(apart.x, apart.y)
    assert np.allclose(scorer.score(apart), np.bincount(apart.row, np.log10(p)), rtol=1e-3)


def test_share_comes_from_all_texts_that_waited():
    """However many there are; and the weights learn from them afterwards."""
    import pickle

    subwords = lm_score.Subwords(lm_score.load_ranks(f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken"))
    r = random.Random(5)
    lines = [" ".join(r.choice(["the", "cat", "sat", "on", "a", "mat", "green", "lamps"]) for _ in range(r.randrange(3, 30))) for _ in range(900)]
    stream = lm_score.Stream(*lm_score.text_bytes(pa.array(lines)), subwords)
    pairs, counts = np.unique(stream.x.astype(np.int64) * lm_score.VOCAB + stream.y, return_counts=True)
    attention = lm_score.Attention()
    attention.ready()
    scorer = lm_score.Scorer(subwords, attention, pairs, counts)
    before = attention.score(stream.x, stream.y, stream.row).mean()
    sent = type("Sent", (), {"value": scorer})
    ratios, weights = np.zeros(lm_score.BINS, int), []
    for part in (lines[:400], lines[400:]):  # two partitions
        rows = [x for b in lm_score._settle(sent, 2)(iter([pa.record_batch([pa.array(part)], ["text"])])) for x in b.to_pylist()]
        ratios += sum(pickle.loads(x["data"]) for x in rows if x["kind"] == lm_score.RATIOS)
        weights += [pickle.loads(x["data"]) for x in rows if x["kind"] == lm_score.WEIGHTS]
    assert ratios.sum() == len(stream.y)
    attention.w = lm_score._whole(weights)[1]
    attention.ready()
    assert attention.score(stream.x, stream.y, stream.row).mean() > before


def test_base_score(spark, texts, small):
    import math
    import zlib
    from collections import Counter

    got = {r.doc_id: r for r in QUERIES["op8_lm_score"](spark, small).collect()}
    counts = Counter()
    for d, t in texts:
        if zlib.crc32(str(d).encode()) % 7 != 2:
            counts.update([*brute.words(t), None])
    total, distinct = sum(counts.values()), len(counts)
    for d, t in texts:
        tokens = [*brute.words(t), None]
        assert got[d].n_tokens == len(tokens) and got[d].train_tokens == total and got[d].n_known == sum(counts[w] > 0 for w in tokens)
        assert got[d].base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in tokens))
    assert pa.array([r.score for r in got.values()]).null_count == 0


# exact deduplication


def _parts(spark, texts):
    from basalt.llm import exact_dedup

    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    return [r.parts for r in exact_dedup.chunks(rows, "t").orderBy("k").collect()]


def test_chunks_join_to_the_text(spark):
    r = np.random.default_rng(2)
    texts = ["", " ", "\x01", "a\x01\x02b \x01\x03", "x" * 30000, "\n".join(["la la la"] * 4000), " ".join("".join(map(chr, r.integers(0x4E00, 0x4F00, 7))) for _ in range(9000))]
    for text, parts in zip(texts, _parts(spark, texts)):
        assert "".join(parts) == text and all(0 < len(p) <= 8192 for p in parts)


def test_an_insertion_keeps_the_other_chunks(spark):
    r = np.random.default_rng(3)
    words = ["".join(map(chr, r.integers(97, 123, r.integers(2, 9)))) for _ in range(900)]
    text = " ".join(words[k] for k in r.integers(0, 900, 30000))
    texts = [text, "z" * 50 + " " + text, text[:333] + "333 new" + text[333:], text[:70000] + " Q" * 40 + text[70000:], text[90000:] + text[:90000]]
    whole, *others = _parts(spark, texts)
    assert 500 < np.mean([len(p) for p in whole]) < 1500
    for parts in others:
        assert len(set(whole) & set(parts)) >= 0.9 * len(set(whole))


@pytest.mark.parametrize("values", [1, 3])
def test_colliding_identifiers(spark, monkeypatch, values):
    """Equal identifiers of unequal chunks don't make texts equal, with ids missing or not."""
    from basalt.llm import exact_dedup

    monkeypatch.setattr(exact_dedup, "identifier", lambda part: F.pmod(F.xxhash64(part), F.lit(values)))
    rows = [(1, "one"), (2, "two"), (3, "ONE"), (None, "one"), (None, "two"), (4, None), (5, ""), (6, "three")]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id or 0), r.keep_id, r.group_size, r.kept) for r in got) == [
        (0, 2, 2, False), (0, 3, 3, False), (1, 3, 3, False), (2, 2, 2, True), (3, 3, 3, True), (4, 5, 2, False), (5, 5, 2, True), (6, 6, 1, True),
    ]


# neighbours


def test_recall_and_search(spark, monkeypatch):
    """The graph of many blocks with search against brute force, and search mending a poor graph."""
    from basalt.llm import neighbours

    monkeypatch.setattr(neighbours, "BLOCK", 512)  # wider vectors make no smaller ones
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    ids = np.array([r.vec_id for r in vectors.select("vec_id").orderBy("vec_id").collect()])
    x = np.stack([np.array(r.embedding, float) for r in vectors.orderBy("vec_id").collect()])
    queries = vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"))

    def recall(found):
        got = {}
        for r in found.collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        hits = []
        for q in ids[ids % 20 == 0]:
            s = x @ x[np.searchsorted(ids, q)]
            s[ids == q] = -np.inf
            hits.append(len(set(ids[np.argsort(-s)[:20]].tolist()) & got[q]) / 20)
        return np.mean(hits)

    assert recall(neighbours.Graph(vectors).search(queries)) >= 0.97
    poor = neighbours.Graph(vectors, k=10, rounds=1)
    assert poor.depth == 2 and poor.vectors.count() >= 4
    few, many = (recall(poor.search(queries, beam=60, visits=20, rounds=r)) for r in (1, 4))
    assert many > few + 0.1


def test_lists_by_fewer_comparisons():
    """The best of each list, of edges given many times, as three sorts by comparison give them, in well under their time."""
    import time

    from basalt.llm.neighbours import OLD, _best

    def plainly(at, other, score, flag, n, k):
        by = np.lexsort((flag, other, at))
        by = by[np.append(True, (np.diff(at[by]) != 0) | (np.diff(other[by]) != 0))[: len(by)]]
        by = by[np.lexsort((other[by], -score[by], at[by]))]
        rank = np.arange(len(by)) - np.searchsorted(at[by], at[by])
        by, rank = by[rank < k], rank[rank < k]
        out = []
        for values, none in ((other, -1), (score, -np.inf), (flag, OLD)):
            table = np.full((n, k), none, values.dtype)
            table[at[by], rank] = values[by]
            out.append(table)
        return out

    def timed(f, *given):
        began = time.process_time()
        return f(*given), time.process_time() - began

    r = np.random.default_rng(2)
    at, which = r.integers(0, 4000, 300_000), r.integers(0, 3000, 300_000)
    flag, names = r.integers(0, 4, 300_000).astype(np.int8), np.concatenate([[0], r.integers(1, 1 << 44, 2999)])
    for scores in (np.round(r.normal(size=3000), 2).astype(np.float32) * np.float32(0.5), np.append(r.normal(size=2998), [0.0, -0.0])):
        given = at, names[which], scores[which], flag, 4000, 40
        runs = [(timed(_best, *given), timed(plainly, *given)) for _ in range(3)]
        (got, _), (want, _) = runs[0]
        assert all(np.array_equal(a, b) for a, b in zip(got, want, strict=True))
        assert min(g[1] for g, _ in runs) < 0.85 * min(p[1] for _, p in runs)


def test_recall_among_near_copies(spark):
    """A large group of near but not equal vectors: order below the rounding of half precision still counts."""
    from basalt.llm import neighbours

    r = np.random.default_rng(6)
    x = r.normal(size=64) / 8 + r.normal(size=(5000, 64)) * (0.005 / 8)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    asked = list(range(0, 5000, 100))
    got: dict[int, set] = {}
    for f in neighbours.Graph(table).search(spark.createDataFrame([(k,) for k in asked], "query_id long")).collect():
        got.setdefault(f.query_id, set()).add(f.vec_id)
    hits = []
    for q in asked:
        s = x @ x[q]
        s[q] = -np.inf
        hits.append(len(set(np.argsort(-s)[:20].tolist()) & got[q]) / 20)
    print("recall", np.mean(hits))
    assert np.mean(hits) >= 0.8
