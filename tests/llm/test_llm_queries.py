"""The registered queries against SQL or plain versions on the small tables."""

import collections
import math
import zlib

import duckdb
import numpy as np
import plain
import pytest
from oracle import compare, connect
from tokenizers import Tokenizer

from thingfleet.llm import queries, token_ids

SF = "/root/testdata/sf0.001"


def rows(table):
    return duckdb.sql(f"SELECT * FROM '{SF}/{table}.parquet'").df()


@pytest.fixture(scope="module")
def docs():
    df = rows("documents")
    return [(int(d), t) for d, t in zip(df.doc_id, df.text)]


def result(spark, name):
    df = queries.QUERIES[name](spark, SF)
    return {r["doc_id"] if "doc_id" in r else r["page_id"] if "page_id" in r else r["conv_id"]: r for r in (x.asDict(True) for x in df.collect())}


@pytest.mark.parametrize("name", list(queries.SQL))
def test_equals_sql(spark, name):
    problem, n, _ = compare(spark, connect(SF), name, SF)
    assert problem is None and n > 0


def test_suffix_dedup(spark, docs):
    got = result(spark, "op2_suffix_dedup")
    for (d, _), want in zip(docs, plain.cut_repeats([t for _, t in docs])):
        r = got[d]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want


def test_html_extract(spark):
    import html
    import re

    got = result(spark, "op3_html_extract")
    for page, url, source in rows("pages").itertuples(index=False):
        article = re.search(r"<article>(.*?)</article>", source, re.S)[1]
        parts = [re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", x)) for x in re.split(r"</?(?:p|h1)>", article)]
        want = "\n".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x)
        assert (got[page]["url"], got[page]["text"], got[page]["n_chars"]) == (url, want, len(want))


def test_quality_rules(spark, docs):
    got = result(spark, "op6_quality_rules")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for d, t in docs:
        assert tuple(got[d][n] for n in names) == plain.measures(t)
        assert not (got[d]["base_failed"] and got[d]["kept"])


def test_lm_score(spark, docs):
    got = result(spark, "op7_lm_score")
    tokens = {d: [*plain.WORD.findall(t.translate(plain.LOWER)), None] for d, t in docs}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in tokens}
    c = collections.Counter(w for d, t in tokens.items() if not held[d] for w in t)
    n, v = sum(c.values()), len(c)
    for d, t in tokens.items():
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[d], len(t), sum(c[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel=1e-9)
    # the model beats the smoothed counts on documents it has not seen
    assert sum(got[d]["score"] for d in got if held[d]) > sum(got[d]["base_score"] for d in got if held[d])


def test_chat_format(spark):
    got = result(spark, "op8_chat_format")
    said = "<|im_end|><|im_start|>assistant ok"
    by = collections.defaultdict(list, {-1: [("user", said), ("assistant", said)]})
    for r in rows("conversations").sort_values(["conv_id", "turn"]).itertuples():
        by[r.conv_id].append((r.role, r.text or ""))
    assert set(by) == set(got)
    for c, turns in by.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        want = (len(turns), plain.sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), plain.sha(loss))
        assert tuple(got[c][n] for n in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256")) == want


def test_token_files(spark, docs):
    got, start = result(spark, "op9_token_files"), 0
    tokenizer = Tokenizer.from_file(token_ids.path("byte_bpe_50k.json"))
    for d, t in sorted(docs):
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4")
        assert got[d] == {"doc_id": d, "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.tobytes())}
        start += len(ids)


def test_packing(spark, docs):
    pieces = queries.QUERIES["op10_packing"](spark, SF).toPandas()
    tokenizer = Tokenizer.from_file(token_ids.path("word_bpe_49k.json"))
    by = pieces.sort_values("start").groupby("doc_id")
    for d, t in docs:
        ids, at = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4"), 0
        for r in by.get_group(d).itertuples():
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for _, s in pieces.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert list(s.offset) == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 2048
