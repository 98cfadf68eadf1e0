"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, against plain versions."""

import random

import plain
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from thingfleet.llm import (
    chat_format,
    decontaminate,
    html_extract,
    jaccard_join,
    line_runs,
    lm_score,
    packing,
    quality_rules,
    suffix_dedup,
    token_files,
)
from thingfleet.llm.common import Bloom, components

rng = random.Random(4)


def prose(n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


PASSAGE, BASE = prose(60, 10_000), prose(200, 5000)
COMMON = "This very line is found in many of the documents."
TEXTS = [
    None,
    "",
    " \t\n ",
    "short",
    "one two three",
    "ONE two\tthree",
    BASE,
    BASE,
    BASE.replace("w1", "W1"),
    BASE + " tail",
    BASE[: len(BASE) // 2],
    "a" * 5000,
    "ab" * 700,
    f"{PASSAGE}\n{COMMON}\n{prose(20)}",
    f"{prose(30)}\n  {COMMON.upper()} \n{COMMON}\n",
    f"{COMMON}\n\n{prose(10)} {PASSAGE}",
    f"{prose(700)}\n{COMMON}\r\n" * 3,
    prose(30_000, 20_000),
    "é ü 漢字 " * 60,
    "\x00\x1c odd \x85 white　space <|endoftext|> ",
]
DOCS = list(enumerate(TEXTS))
LONE = [(d, t) for d, t in DOCS if d not in (7,)]


@pytest.fixture(scope="module")
def docs(spark):
    """Documents whose further columns bear names that the operators use."""
    clash = ("row_key", "lang", "gone", "h1", "part", "ids", "spans", "found", "bins", "key", "doc", "lines", "_doc", "n_lines", "node")
    df = spark.createDataFrame([(d, t) for d, t in DOCS], "doc_id long, text string").repartition(3)
    lists = ("bounds", "split", "mark", "new_text", "left_text")
    return df.withColumns({c: F.lit(f"own {c}") for c in clash} | {c: F.array(F.lit("own"), F.lit(c)) for c in lists})


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("doc_id < 0")


@pytest.fixture(scope="module")
def twice(docs):
    """Every row twice, and two texts without an id."""
    extra = docs.limit(1).select(*[F.lit(None).cast("long").alias("doc_id") if c == "doc_id" else F.lit(BASE).alias(c) if c == "text" else c for c in docs.columns])
    return docs.unionByName(docs).unionByName(extra)


def by_id(df):
    return {r["doc_id"]: r.asDict(True) for r in df.collect()}


ITEMS = [(1, PASSAGE), (2, PASSAGE), (3, "one two"), (4, None), (5, ""), (6, "ab"), (None, BASE), (7, BASE[:300] + " x")]


def test_contamination(spark, docs, none, twice):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = by_id(decontaminate.contamination(docs, items))
    for d, t in DOCS:
        n, hit, found = plain.hits(t, [(i, x) for i, x in ITEMS if i is not None])
        assert (got[d]["n_words"], got[d]["n_hit"], got[d]["item_ids"]) == (n, hit, found)
    again = decontaminate.contamination(twice, items)
    assert again.count() == 2 * len(DOCS) + 1
    assert {r["n_hit"] for r in again.where("doc_id = 13").collect()} == {got[13]["n_hit"]}
    assert decontaminate.contamination(none, items).count() == 0
    clean = decontaminate.contamination(docs, items.where("item_id < 0"))
    assert clean.where("n_hit > 0 or size(item_ids) > 0").count() == 0 and clean.count() == len(DOCS)


def test_winnowing_meets_every_window():
    import numpy as np

    for span in range(1, 14):
        run = np.random.default_rng(span).integers(0, 2**63, span, dtype=np.uint64)
        for k in range(20):
            noise = np.random.default_rng(100 + k).integers(0, 5, 30, dtype=np.uint64)
            _, a = decontaminate.winnow(run, span)
            _, b = decontaminate.winnow(np.concatenate([noise[: k % 7], run, noise[k % 7 :]]), span)
            assert set(a) & set(b)


def test_suffix_dedup(docs, none, twice):
    want = dict(zip([d for d, _ in DOCS], plain.cut_repeats(TEXTS)))
    got = by_id(suffix_dedup.remove_repeats(docs))
    assert len(got) == len(DOCS)
    for d, row in got.items():
        runs = row["removed"]
        assert (row["n_bytes"], sum(r["end"] - r["start"] for r in runs), len(runs), plain.sha(bytes(row["kept"]))) == want[d]
    # of rows that are there twice all that is long enough goes
    again = suffix_dedup.remove_repeats(twice)
    assert again.count() == 2 * len(DOCS) + 1 and again.where("n_bytes >= 400 and length(kept) > 0").count() == 0
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_suffix_dedup_of_heavy_cores(docs, spark, monkeypatch):
    r = random.Random(3)
    texts = [f"{prose(9 + k)} {PASSAGE} {PASSAGE[::-1]} {prose(9)}" for k in range(12)] + [prose(90) for _ in range(3)]
    rows = spark.createDataFrame(list(enumerate(r.sample(texts, len(texts)))), "doc_id long, text string")
    both = docs.where("doc_id in (6, 7, 9, 11, 12)").select(F.col("doc_id") + 100, "text").union(rows).toDF("doc_id", "text")
    spans = lambda hot: {q.doc_id: q.spans for q in suffix_dedup.repeated_spans(both, hot=hot).collect()}
    joined, sort = [], suffix_dedup.repeated_in_blocks
    monkeypatch.setattr(suffix_dedup, "repeated_in_blocks", lambda p, *a: joined.append(p.groupBy("key").agg(F.sum(F.length("piece")).alias("b")).agg(F.max("b")).first()[0]) or sort(p, *a))
    covered = lambda s: {d: set().union(*(range(x >> 32, x & 0xFFFFFFFF) for x in v)) for d, v in s.items()}
    want, got = spans(1 << 30), spans(2000)
    assert len(want) > 12 and covered(got) == covered(want)
    assert joined[0] > 2000 and (joined[1] or 0) <= 2000  # no sort holds a heavy core


def test_suffix_array():
    for k in range(60):
        t = bytes(rng.choice(b"abcA") if rng.random() < 0.9 else rng.choice(b"xyz") for _ in range(rng.randint(1, 150)))
        t = t + t[:40] + b"a" * 20 + b"\xff"
        order = suffix_dedup.suffix_array(t)
        assert list(order) == sorted(range(len(t)), key=lambda i: t[i:])
        for a, b, n in zip(order, order[1:], suffix_dedup.common_prefixes(t, order)):
            assert t[a : a + n] == t[b : b + n] and t[a + n : a + n + 1] != t[b + n : b + n + 1]


PAGE = """<html><body><header><a href=x>Home</a> Site</header><div class="cookie-notice">We use cookies.</div>
<article class="post"><h1>Title&nbsp;of &quot;it&quot;</h1><p>First <b>part,<br>with</b>  more.<p>Second &amp; last.
<ul><li>a point of it<li>another point</ul><aside>Read more</aside><div class="comments"><p>Nice, thanks!</p></div>
<form><p>Send us mail.</p></form><script>if (a < b) { "</p>" }</script></article><footer><p>Rights.</p></footer></body></html>"""


def test_html_extract(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p>unclosed"), (5, "u", "<" * 50), (1, "u", PAGE)]
    rows += [(6, "u", "<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("blocks", F.lit(1)).withColumn("text", F.lit("x"))
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()}
    assert got[1] == 'Title of "it"\nFirst part, with more.\nSecond & last.\na point of it\nanother point'
    assert (got[2], got[3], got[6]) == ("", "", "deep") and set(got) == {1, 2, 3, 4, 5, 6}
    assert html_extract.extract(pages.where("page_id < 0")).count() == 0


def test_marginals_are_exact():
    """Messages on the tree give what summing over all states gives."""
    import itertools
    import math

    page = html_extract.parse("<div class=main><p>Some text, of a block.</p><ul><li>x<li><a href=y>z</a></ul></div><nav>n</nav>")
    model = html_extract.Model.fit({})
    nodes, total, content = page.nodes, 0.0, [0.0] * len(page.nodes)
    for states in itertools.product((0, 1), repeat=len(nodes)):
        p = math.log((0.8, 0.2)[states[0]])
        for n, s in zip(nodes, states):
            p += s * model.own(n)
            if n.parent >= 0:
                p += model.edges[html_extract.edge_kind(nodes[n.parent])][states[n.parent]][s]
        total += math.exp(p)
        for k, s in enumerate(states):
            content[k] += s * math.exp(p)
    assert model.marginals(page) == pytest.approx([c / total for c in content])


def test_jaccard_join(spark, docs, none, twice):
    want = plain.components(DOCS)
    for df in (docs, twice.where("doc_id is not null")):
        for r in jaccard_join.grouped(df).collect():
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
    assert jaccard_join.grouped(twice).where("doc_id is null and component_id is null").count() == 1
    assert jaccard_join.grouped(none).count() == 0
    # chains and groups of random near copies
    made = []
    for g in range(12):
        words = prose(rng.randint(20, 150), 3000).split()
        for _ in range(rng.randint(1, 9)):
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = f"n{rng.randrange(9999)}"
            made.append(" ".join(words + ["x"] * rng.randint(0, 3)))
    rows = list(enumerate(made))
    rng.shuffle(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.grouped(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain.components(rows)


def test_jaccard_join_gives_all_links(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 7)
    r = random.Random(9)
    base = [f"v{r.randrange(4000)}" for _ in range(160)]
    rows = []
    for d in range(30):  # near copies of one text, many of them linked with each other
        words = list(base)
        words[r.randrange(160)] = f"x{d}"
        rows.append((d, " ".join(words[: 160 - r.randrange(30)])))
    rows += [(200, "some text of its own, with no link"), (201, rows[0][1]), (202, None)]
    sets = {}
    for (d, _), s in zip(rows, jaccard_join.shingle_sets([t for _, t in rows])):
        if len(s):
            sets.setdefault(s.tobytes(), (d, set(s.tolist())))
    brute = {}
    for a, x in sets.values():
        for b, y in sets.values():
            if a < b and 100 * len(x & y) >= 85 * len(x | y):
                brute[a, b] = (len(x & y), len(x | y))
    assert 100 < len(brute) < 435
    _, links, counts, _ = jaccard_join.similar_sets(spark.createDataFrame(rows, "doc_id long, text string"))
    got = [(min(q.x, q.y), max(q.x, q.y), q.common, q.union) for q in links.collect()]
    assert len(got) == len(brute) and {(a, b): (c, u) for a, b, c, u in got} == brute
    per = {d: sum(d in pair for pair in brute) for d, _ in sets.values()}
    assert {q.node: q.n_links for q in counts.collect()} == {d: n for d, n in per.items() if n}


def test_jaccard_join_reads_few_texts_of_a_group(spark, monkeypatch):
    r = random.Random(5)
    base = [f"v{r.randrange(4000)}" for _ in range(150)]
    rows = []
    for d in range(240):  # copies with two words changed: some of the pairs are linked, most of them not
        words = list(base)
        for k in r.sample(range(150), 2):
            words[k] = f"x{d}-{k}"
        rows.append((d, " ".join(words)))
    read, real = [], jaccard_join.verified

    def counted(pairs, *a):
        read.append(pairs.count())
        return real(pairs, *a)

    monkeypatch.setattr(jaccard_join, "verified", counted)
    got = {q["doc_id"]: (q["n_shingles"], q["component_id"]) for q in jaccard_join.grouped(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain.components(rows)
    assert sum(read) < 12 * len(rows)


def test_parities_bound_the_difference():
    import numpy as np

    r = np.random.default_rng(3)
    for n, m in ((1, 9), (40, 60), (500, 530), (900, 2500)):
        x = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
        y = np.unique(np.concatenate([x[: n - n // 10], r.integers(0, 1 << 63, m - n, dtype=np.uint64)]))
        a, b = jaccard_join.parities(x), jaccard_join.parities(y)
        assert jaccard_join.odd_bits(a, b) == jaccard_join.odd_bits(b, a) <= len(np.setxor1d(x, y))
        assert jaccard_join.odd_bits(a, a) == 0
        odd = jaccard_join.sketch(x) ^ jaccard_join.sketch(y)
        assert len(odd) == jaccard_join.SKETCH and np.bitwise_count(odd.view(np.uint64)).sum() <= len(np.setxor1d(x, y))


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (103, 101), (7, 7)]
    rows = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in rows} == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 103: 100}


def test_line_dedup(docs, none, twice):
    want = plain.line_dedup(DOCS)
    out = line_runs.dedup_lines(docs, batches=5, fanout=2)
    assert {"row_key", "gone", "doc", "lines"} <= set(out.columns) and out.where("gone <> 'own gone' or doc <> 'own doc'").count() == 0
    for df in (out, line_runs.dedup_lines(twice).where("doc_id is not null")):
        for r in df.collect():
            assert (r["n_lines"], r["n_dropped"], r["new_text"]) == want[r["doc_id"]]
    assert line_runs.dedup_lines(none).count() == 0


def test_line_runs_levels(spark):
    runs = line_runs.LineRuns(spark, fanout=2)
    for k in range(5):
        runs.add(spark.createDataFrame([(1, 1, k), (k, 2, k), (k, 2, k)], "h1 long, h2 long, doc_id long"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    got = {(r["h1"], r["h2"]): (r["n_docs"], r["last_doc"]) for r in runs.totals().collect()}
    assert got == {(1, 1): (5, 4), **{(k, 2): (1, k) for k in range(5)}}


def test_quality_rules(spark, docs, none, twice):
    labels = spark.createDataFrame([(d, 1, 0) for d, _ in DOCS] + [(6, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = by_id(quality_rules.judge(docs, labels))
    for d, t in DOCS:
        r = got[d]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == plain.measures(t)
        assert r["kept"] is not r["base_failed"]  # too few labels to certify any cutoff
    assert quality_rules.judge(twice, labels.where("doc_id < 0")).count() == 2 * len(DOCS) + 1
    assert quality_rules.judge(none, labels).count() == 0


def test_cutoffs_are_certified(spark):
    rows, labels = [], []
    for d in range(1600):
        bad = d % 4 == 0
        words = [f"w{rng.randrange(3000)}" for _ in range(80)]
        if bad:
            words[::9] = [f"vile{rng.randrange(50)}" for _ in words[::9]]
        rows.append((d, " ".join(words), "en"))
        labels.append((d, 1, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = quality_rules.judge(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    lost = out.where("not kept and doc_id % 4 <> 0").count()
    caught = out.where("not kept and doc_id % 4 = 0").count()
    assert lost <= 0.03 * 1200 and caught >= 0.95 * 400


def test_small_languages_are_certified_by_themselves(spark):
    r = random.Random(5)
    rows, labels = [], []
    for d in range(1060):
        lang = "bb" if d % 106 == 0 else "ac"[d % 2] * 2
        bad = lang != "bb" and d % 4 == 1
        words = [f"w{r.randrange(3000)}" for _ in range(80)]
        if bad or lang == "bb":  # good documents of the small language look like bad ones of the others
            words[::9] = [f"vile{r.randrange(50)}" for _ in words[::9]]
        rows.append((d, " ".join(words), lang))
        labels.append((d, 1, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = quality_rules.judge(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    lost = {q.doc_id for q in out.where("not kept").collect()}
    assert not lost & {d for d, _, lang in rows if lang == "bb"}
    # the other languages are certified by their own rows
    assert len(lost & {d for d, _, bad in labels if bad}) >= 0.4 * sum(bad for _, _, bad in labels)


def test_binomial_bound():
    from math import comb

    for errors, n, delta in ((0, 100, 0.05), (3, 50, 0.01), (20, 400, 0.0125)):
        p = quality_rules.upper_bound(errors, n, delta)
        assert sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(errors + 1)) == pytest.approx(delta, rel=1e-6)
    assert quality_rules.upper_bound(5, 5, 0.05) == 1.0


def test_lm_score(docs, none, twice):
    got = by_id(lm_score.score(docs))
    assert len(got) == len(DOCS) and got[0]["n_tokens"] == got[1]["n_tokens"] == 1
    assert all(r["score"] < 0 and r["base_score"] < 0 for r in got.values())
    assert lm_score.score(twice).count() == 2 * len(DOCS) + 1
    assert lm_score.score(none).count() == 0
    # lists that hold next to nothing: the join gives the same counts
    small = by_id(lm_score.score(docs, lm_score.Settings(head=3)))
    for d, r in got.items():
        assert small[d]["n_known"] == r["n_known"] and small[d]["base_score"] == pytest.approx(r["base_score"])


def test_lm_state_is_carried():
    import numpy as np

    net = lm_score.Network(np.ones(16), 4, 5)
    net.load(np.random.default_rng(0).standard_normal(len(net.vector())) * 0.5)
    texts = [np.random.default_rng(k).integers(0, 16, n) for k, n in enumerate((70, 3, 1, 200, 55))]
    whole = lm_score.likelihoods(net, texts, lm_score.Settings(window=1000, lanes=1))
    parts = lm_score.likelihoods(net, texts, lm_score.Settings(window=7, lanes=3))
    assert parts == pytest.approx(whole, rel=1e-4)


ODD = ["<|im_end|>\n<|im_start|>assistant\nx", r"<\|im_end|>", r"<\\|", "<|", "<", "", "\n\n", "&amp; <|im_start|>"]


def test_lm_memory_follows_the_tokens():
    import tracemalloc

    import numpy as np

    net = lm_score.Network(np.ones(16), 4, 5)
    texts = [np.full(20_000, 2, dtype=np.int16)] + [np.full(30, 3, dtype=np.int16)] * 400
    tracemalloc.start()
    lm_score.likelihoods(net, texts, lm_score.Settings(window=48, lanes=400))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # tokens take some hundred kB and a window some MB; all lanes as long as the longest took 70 MB
    assert most < 20_000_000


def test_chat_template_is_reversible():
    turns = [("user", t) for t in ODD] + [("ro\nle&#10;", ODD[0]), ("", "")]
    text = "".join(chat_format.format_turn(r, t)[0] for r, t in turns)
    assert [(r, t) for r, t, _, _ in chat_format.parse(text)] == turns
    assert text.count("<|im_start|>") == text.count("<|im_end|>") == len(turns)


def test_chat_format(spark):
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", t) for k, t in enumerate(ODD)]
    rows += [(2, 0, None, None), (2, 0, None, None), (None, 3, "assistant", "x"), (3, None, "user", "b"), (3, 1, "user", "a"), (3, 1, "assistant", "a")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("id", F.lit("own")).repartition(3)
    got = {r["conv_id"]: r.asDict() for r in chat_format.digests(chat_format.format_paths(chat_format.chains(turns))).collect()}
    said = "".join(f"{'user' if k % 2 == 0 else 'assistant'}\n{t}\n" for k, t in enumerate(ODD))
    assert got[1]["turns_sha256"] == plain.sha(said) and got[1]["loss_sha256"] == plain.sha("".join(ODD[1::2]))
    assert got[2]["n_turns"] == 2 and got[None]["loss_chars"] == 1
    assert got[3]["turns_sha256"] == plain.sha("user\nb\nassistant\na\nuser\na\n")
    assert chat_format.digests(chat_format.format_paths(chat_format.chains(turns.where("conv_id > 9")))).count() == 0


def test_reply_tree(spark):
    """The best branch by mean score, and the two best."""
    nodes = [(0, None, 1.0), (1, 0, 0.0), (2, 0, 5.0), (3, 1, 9.0), (4, 2, 1.0), (5, 4, 0.0), (10, None, 0.0)]
    df = spark.createDataFrame([(*n, 1, "user", f"t{n[0]}") for n in nodes], "id long, parent long, score double, conv_id long, role string, text string")

    def chosen(best):
        out = {}
        for r in chat_format.paths(df, best).collect():
            out.setdefault((r["root"], r["rank"]), {})[r["up"]] = r["id"]
        return {k: [v[u] for u in sorted(v, reverse=True)] for k, v in out.items()}

    assert chosen(1) == {(0, 1): [0, 1, 3], (10, 1): [10]}
    assert chosen(2) == {(0, 1): [0, 1, 3], (0, 2): [0, 2, 4, 5], (10, 1): [10]}


def test_token_files(spark, docs, none, twice, tmp_path):
    import numpy as np
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_files.path("byte_bpe_50k.json"))
    target = token_files.write_tokens(token_files.tokenized(docs), str(tmp_path / "a"))
    start = 0
    for r in sorted(token_files.read_tokens(spark, target).collect(), key=lambda r: r["doc_id"]):
        assert r["ids"] == [*tokenizer.encode(TEXTS[r["doc_id"]] or "", add_special_tokens=False).ids, 2]
    for r in sorted(token_files.digests(spark, target).collect(), key=lambda r: r["doc_id"]):
        assert r["start"] == start
        start += r["n_tokens"]
    some = token_files.read_tokens(spark, target, ["doc_id", "n_tokens"], "doc_id = 3")
    assert some.count() == 1
    import pyarrow.parquet as pq

    file = pq.ParquetFile(next(p for p in (tmp_path / "a").glob("part-*.parquet") if pq.ParquetFile(p).metadata.num_rows))
    columns = {file.metadata.row_group(0).column(k).path_in_schema: file.metadata.row_group(0).column(k) for k in range(4)}
    assert any("DICTIONARY" in e for e in columns["ids.list.element"].encodings) and columns["doc_id"].has_column_index
    assert token_files.digests(spark, token_files.write_tokens(token_files.tokenized(none), str(tmp_path / "b"))).count() == 0
    again = token_files.digests(spark, token_files.write_tokens(token_files.tokenized(twice), str(tmp_path / "c"))).toPandas().sort_values("start")
    assert list(again.start) == [0, *np.cumsum(again.n_tokens)[:-1]] and again.n_tokens.sum() > 2 * start


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_by_chunks_are_those_of_whole_texts(name):
    from thingfleet.llm import token_ids

    letters = "aA bB'’sS,.!é́ßİıΣςK½Ⅷ٣_#<|>\t\n漢ﬁǅ 12"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(5000)]
    texts += ["it's we'll <|endoftext|> FOO, Foo. foo###", "", "  ", " x", "Straße, STRASSE."]
    ids = token_ids.Ids(token_ids.path(name), limit=50)
    assert ids.encode(texts) == ids._whole(texts)


def test_new_chunks_are_encoded_many_at_a_time(monkeypatch):
    from thingfleet.llm import token_ids

    ids = token_ids.Ids(token_ids.path("byte_bpe_50k.json"))
    words = [f"{a}{b}{c}'s{k}" for k, (a, b, c) in enumerate(zip("añß漢é" * 200, "x<|endoftext|>\u200b" * 60, "#Zq-1" * 200))]
    texts = [" ".join(words[k : k + 50]) + "\nend" for k in range(0, len(words), 50)] + ["a \n b", " c", "d\u2003e", "\n", "\x1cf", "g\x85"]
    calls, whole = [], ids._whole
    monkeypatch.setattr(ids, "_whole", lambda part: calls.append(len(part)) or whole(part))
    assert ids.encode(texts) == whole(texts)
    # chunks with white space inside and texts that go through whole are all that is encoded one by one
    assert sum(calls) < 20


def test_packing(docs, none, twice):
    for df, n in ((docs, len(DOCS)), (twice, 2 * len(DOCS) + 1)):
        rows = packing.pack(df, flush_tokens=20_000).toPandas()
        assert (rows.start == 0).sum() == n
        for _, s in rows.groupby("sequence_id"):
            total = s.length.sum()
            assert total == s.tier.iloc[0] and total & (total - 1) == 0
        steps = rows.drop_duplicates("sequence_id").groupby("step_group").tier.sum()
        assert steps.max() <= 1 << 16
    assert packing.pack(none).count() == 0


def test_word_hashes():
    """The same word has the same hash wherever it stands, also where a long text is cut; others differ."""
    from thingfleet.llm import common

    texts = [b"", b"  a\tb\n", b"word " * 3, b"x", b"long " * 300_000 + b"end", b"\x00 \xc3\xa9 a", b"no" * 700_000 + b" a"]
    got, seen = common.word_hashes(texts), {}
    for t, h in zip(texts, got):
        assert len(h) == len(t.split())
        for w, x in zip(t.split(), h):
            assert seen.setdefault(w, x) == x
    many = [str(k).encode() for k in range(200_000)]
    assert len(set(common.word_hashes([b" ".join(many)])[0])) == len(many) and len(set(seen.values())) == len(seen)


def test_windows_hold_every_token_once():
    for k in range(400):
        lengths = [rng.choice([1, 2, 255, 257, 900, 1500, 2047, 2048, 5000, rng.randint(1, 3000)]) for _ in range(rng.randint(0, 12))]
        seen = {}
        for size, pieces in packing.pack_lengths(lengths):
            assert sum(p[2] for p in pieces) == size and size & (size - 1) == 0 and size <= 2048
            for doc, at, n in pieces:
                seen.setdefault(doc, []).append((at, n))
        for doc, n in enumerate(lengths):
            at = 0
            for a, m in sorted(seen[doc]):
                assert a == at
                at += m
            assert at == n


def test_bloom_forgets_nothing():
    import numpy as np

    h = np.random.default_rng(0).integers(0, 2**63, 5000, dtype=np.uint64)
    b = Bloom(1 << 16)
    b.add(h[:2000])
    assert b.has(h[:2000]).all() and b.has(h[2000:]).mean() < 0.2


def test_stages(spark, docs, none, tmp_path):
    labels = [(d, 1, 0) for d, _ in DOCS]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = dict(DOCS)
    kept = {d: t for d, t in kept.items() if not plain.measures(t)[5]}
    now = docs
    plans = [
        lambda k: k,
        lambda k: {d: (k[d] if not r[1] else r[2]) for d, r in plain.line_dedup(list(k.items())).items()},
        lambda k: {d: t for d, t in k.items() if plain.components(list(k.items()))[d][1] == d},
        lambda k: {d: t for d, t in k.items() if not (lambda n, h, _: h > 0 and 20 * h >= n)(*plain.hits(t, [(i, x) for i, x in ITEMS if i is not None]))},
    ]
    for (name, stage), step in zip(corpus_pipeline.STAGES, plans):
        kept = step(kept)
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
        assert {r["doc_id"]: r["text"] for r in now.select("doc_id", "text").collect()} == kept, name
        assert stage(spark, none, str(tmp_path)).count() == 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).toPandas()
    assert set(pieces.doc_id) == set(kept)


def test_the_models_vocabulary_takes_thousands_of_words():
    import numpy as np

    s = lm_score.Settings()
    h = np.arange(1, 2001, dtype=np.uint64)
    v = lm_score.Vocabulary.of(lm_score.Head(h, np.arange(2000) + 1, 2_001_000, 2000), s.classes, s.width)
    assert len(v.h) == 2000 and len(set(v.number(h))) == 2000
