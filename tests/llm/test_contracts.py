"""Every opN_ query on the small tables, held against plain Python or DuckDB: columns, types, masks and values."""

import base64
import hashlib
import os
import re
from collections import Counter
from zlib import crc32

import duckdb
import pyarrow.parquet as pq
import pytest

from pixelloom.llm import queries as Q

from .test_packing import check as check_packing
from .test_simhash import slow_classes, slow_fingerprint

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def table(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def run(spark, name):
    df = Q.QUERIES[name](spark, SF)
    return df, [r.asDict(recursive=True) for r in df.collect()]


def types(df, **want):
    got = dict(df.dtypes)
    assert {k: got.get(k) for k in want} == want


def mod(doc_id, m):
    return crc32(str(doc_id).encode()) % m


def test_op1(spark):
    df, rows = run(spark, "op1_warc")
    types(df, page_id="bigint", payload_bytes="bigint", payload_digest="string", record_type="string", refers_to="bigint")
    pages = {p["page_id"]: (p["html"] or "").encode() for p in table("pages")}
    first = {}
    for i in sorted(pages):
        first.setdefault(pages[i], i)
    want = [(i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if first[b] == i else "revisit", None if first[b] == i else first[b]) for i, b in pages.items()]
    assert sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows) == sorted(want)


def test_op2(spark):
    df, rows = run(spark, "op2_simhash")
    types(df, doc_id="bigint", fingerprint="string", component_id="bigint")
    items = [(d["doc_id"], slow_fingerprint(d["text"])) for d in table("documents")]
    names, find = slow_classes(items)
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows) == sorted((i, f"{fp:016x}", names[find(k)]) for k, (i, fp) in enumerate(items))


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_sql(spark, name):
    df, rows = run(spark, name)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    found = con.execute(Q.SQL[name])
    columns = [c[0] for c in found.description]
    assert set(columns) == set(df.columns)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r[c] for c in columns) for r in rows), key=key) == sorted(found.fetchall(), key=key)


def test_op4(spark):
    df, rows = run(spark, "op4_language")
    types(df, doc_id="bigint", held_out="boolean", lang_pred="string", score="double")
    docs = {d["doc_id"]: d for d in table("documents")}
    assert Counter(r["doc_id"] for r in rows) == Counter(list(docs))
    learned = {d["lang"] for i, d in docs.items() if mod(i, 4) != 2 and d["lang"] is not None}
    for r in rows:
        text = docs[r["doc_id"]]["text"]
        letters = any(c.isalpha() for c in text or "")
        assert r["held_out"] == (mod(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1
        assert r["lang_pred"] in learned if letters else r["lang_pred"] == "und"
        assert not r["spans"] or (r["spans"][0]["start"], r["spans"][-1]["end"]) == (0, len(re.findall(r"[^\x20\x09-\x0D]+", text)))
    held = [r for r in rows if r["held_out"] and r["lang_pred"] != "und" and docs[r["doc_id"]]["lang"]]
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held) >= 0.95 * len(held)


def test_op5(spark):
    df, rows = run(spark, "op5_repetition")
    types(df, doc_id="bigint", n_words="bigint", word_chars="bigint", n_symbols="bigint", n_dup_lines="bigint", n_repeat_words="bigint", base_failed="boolean", kept="boolean")
    got = {r["doc_id"]: r for r in rows}
    assert len(got) == len(rows)
    for d in table("documents"):
        text = d["text"] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        again = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
        lines, seen, twice = text.split("\n"), set(), 0
        for x in lines:
            if re.search(r"[^\x20\x09-\x0D]", x):
                twice += x in seen
                seen.add(x)
        failed = len(words) < 20 or 100 * len(again) > 30 * len(words)
        r = got[d["doc_id"]]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), twice, len(again), failed)
        assert not (failed and r["kept"])


def test_op6(spark):
    df, _ = run(spark, "op6_best_fit")
    types(df, doc_id="bigint", piece="int", start="bigint", length="bigint", ids_crc32="bigint", sequence_id="bigint", offset="bigint")
    used, total = check_packing(df.withColumnRenamed("doc_id", "id").collect(), [(d["doc_id"], d["text"]) for d in table("documents")], 2048)
    assert used <= 1.01 * total / 2048 + 1


def test_op7_types(spark):
    types(Q.op7_block_names(spark, SF), doc_id="bigint", keep_id="bigint", group_size="bigint", kept="boolean", text_sha256="string")


def test_op8(spark):
    df, rows = run(spark, "op8_toxicity")
    types(df, doc_id="bigint", held_out="boolean", score="double", predicted="int")
    docs = {d["doc_id"]: d["text"] for d in table("documents")}
    assert Counter(r["doc_id"] for r in rows) == Counter(list(docs))
    for r in rows:
        assert r["held_out"] == (mod(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        assert all(0 <= s["start"] < s["end"] <= len(docs[r["doc_id"]]) for s in r["offending"])


def test_op9(spark):
    df, rows = run(spark, "op9_main_text")
    types(df, page_id="bigint", url="string", text="string", n_chars="bigint")
    pages = {p["page_id"]: p for p in table("pages")}
    assert Counter(r["page_id"] for r in rows) == Counter(list(pages))
    for r in rows:
        assert r["url"] == pages[r["page_id"]]["url"] and r["n_chars"] == len(r["text"]) and r["text"] == " ".join(r["text"].split())


def test_op10(spark):
    df, rows = run(spark, "op10_site_quality")
    types(df, doc_id="bigint", held_out="boolean", evidence="double", posterior="double", kept="boolean")
    docs = table("documents")
    assert Counter(r["doc_id"] for r in rows) == Counter(d["doc_id"] for d in docs)
    assert all(r["held_out"] == (mod(r["doc_id"], 5) == 0) and r["kept"] == (r["posterior"] >= 0.5) for r in rows)
