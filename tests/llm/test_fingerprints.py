import hashlib
import re
import struct

import pytest
import xxhash

from pairloom.llm import fingerprints as fp

MASK = (1 << 64) - 1


def plain_entries(text, k=5, w=16):
    """Winnowing, window by window; [(hash, position)] without repeats."""
    words = [x for x in re.split(r"[\x20\x09-\x0D]+", text.lower()) if x]
    factors = [pow(0x5DEECE6D, j + 1, 2_147_483_647) for j in range(k)][::-1]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) >> 35 for x in words]
    grams = []
    for i in range(max(len(h) - k, 0) + 1 if h else 0):
        value = sum(x * f for x, f in zip(h[i : i + k], factors))
        grams.append(xxhash.xxh64_intdigest(struct.pack("<q", value), 42) >> 29)
    chosen = []
    for i in range(max(len(grams) - w, 0) + 1 if grams else 0):
        window = grams[i : i + w]
        least = min(window)
        at = i + max(j for j, x in enumerate(window) if x == least)
        if (least, at) not in chosen:
            chosen.append((least, at))
    return chosen


def plain_rows(rows):
    rows = sorted(rows, key=lambda r: (-(1 << 63) if r[0] is None else r[0], r[1] or ""))
    out = []
    for n, (i, text) in enumerate(rows):
        text, following = text or "", rows[(n + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        own, other, later = (plain_entries(x) for x in (text, edited, following))
        sets = [{h for h, _ in x} for x in (own, other, later)]
        near = [len(sets[0] & s) / len(sets[0] | s) if sets[0] | s else 1.0 for s in sets[1:]]
        shown = [" ".join(f"{h:x}@{p}" for h, p in x) for x in (own, other)]
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), *shown, *near))
    return out


def same(got, want):
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_equals_brute_force_on_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    same(fp.fingerprint_edits(docs).collect(), plain_rows([(r.doc_id, r.text) for r in docs.collect()]))


@pytest.mark.parametrize("rows_per_block", [1, 3])
def test_blocks_nulls_ties_and_odd_ids(spark, monkeypatch, rows_per_block):
    monkeypatch.setattr(fp, "ROWS_PER_BLOCK", rows_per_block)
    body = " ".join(f"w{i % 7} é{i}" for i in range(60))
    rows = [(5, body), (-9, "a b c"), (10**15, None), (7, ""), (7, "  \t"), (8, body), (8, body), (9, body.upper() + " x"), (11, "same " * 100), (12, "日本"), (None, "first of all")]
    docs = spark.createDataFrame([(*r, "t", 1) for r in rows], "doc_id long, text string, fingerprint string, block int")
    got = fp.fingerprint_edits(docs).collect()
    same(got, plain_rows(rows))
    assert len({r.fingerprint for r in got if r.doc_id in (5, 8)}) == 1
    assert fp.fingerprint_edits(docs.where("false")).count() == 0
    one = fp.fingerprint_edits(docs.where("doc_id = 5")).collect()
    assert one[0].near_next == 1.0


def test_shared_passage_shares_an_entry(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    docs = spark.createDataFrame([(1, "a b c " + passage + " d"), (2, "x " * 40 + passage)], "doc_id long, text string")
    sets = [{e >> 28 for e in r.entries} for r in fp.winnowed(docs).collect()]
    assert sets[0] & sets[1]
