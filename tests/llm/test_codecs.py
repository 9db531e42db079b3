"""Tokens and archives: exact round trips."""

from __future__ import annotations

import gzip
import hashlib
import io
import random
import struct
import zlib

import corpus_pipeline
import pytest
import tiktoken
from public_tokenizers import PATTERN
from pyspark.sql import functions as F

from disputeflow.llm import bpe, warc
from disputeflow.session import shared_folder

RANKS = bpe.public_ranks()
OTHER = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})


def packed(text):
    ids = OTHER.encode_ordinary(text)
    return struct.pack(f"<{len(ids)}I", *ids)


@pytest.mark.parametrize("seed", range(5))
def test_encoder_equals_the_library(seed, monkeypatch):
    monkeypatch.setattr(bpe, "PIECE", 60)
    rng, encoder, decoder = random.Random(seed), bpe.Encoder(RANKS, PATTERN), bpe.Decoder(RANKS)
    parts = ["a", "aa", "ab", "the", "  ", " ", "\n", "é", "日本", "'s", "1", "!", "\t", "====", "<|endoftext|>", "\u00a0"]
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(120)))
        ids = encoder.encode(text)
        assert ids == packed(text)
        assert decoder.decode(ids) == text.encode()


def test_encoder_keeps_some_between_tasks(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 20)
    monkeypatch.setattr(bpe, "KEPT", 5)
    encoder, rng = bpe.Encoder(RANKS, PATTERN), random.Random(2)
    for _ in range(30):
        text = " ".join(rng.choice("abcdefgh") * rng.randrange(1, 9) for _ in range(40))
        assert encoder.encode(text) == packed(text)
        encoder.rest()
        assert 0 < len(encoder) <= 5 and not encoder.earlier


def test_pipeline_remembers_less_with_the_same_ids(spark):
    texts = [" ".join(f"w{i}x{n}" for n in range(40)) for i in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: bytes(r["token_ids"]) for r in bpe.encode(docs, RANKS, remembered=16).collect()}
    assert found == {i: packed(text) for i, text in enumerate(texts)}
    encoder = bpe.Encoder(RANKS, PATTERN, 16)
    for text in texts:
        assert encoder.encode(text) == packed(text)
        assert len(encoder) <= 16 and len(encoder.earlier) <= 16
    encoder.rest()
    assert len(encoder) <= 8 and not encoder.earlier
    assert corpus_pipeline.REMEMBERED < bpe.REMEMBERED


def test_long_pretoken():
    rng = random.Random(1)
    text = "".join(rng.choice("abcdeth") for _ in range(20_000))
    assert bpe.Encoder(RANKS, PATTERN).encode(text) == packed(text)
    same = "a" * 20_000
    assert bpe.Encoder(RANKS, PATTERN).encode(same) == packed(same)


def test_encode_and_decode_of_odd_rows(spark):
    rows = [(1, None, 5), (2, "", 5), (3, "two words", 5), (3, "two words", 5), (4, "x" * 3000, None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int")
    encoded = bpe.encode(frame, RANKS)
    assert encoded.columns == ["doc_id", "text", "n_tokens", "token_ids"]
    for r in bpe.decode(encoded, RANKS).collect():
        text = r["text"] or ""
        assert bytes(r["token_ids"]) == packed(text)
        assert r["n_tokens"] == len(packed(text)) // 4
        assert bytes(r["decoded"]) == text.encode()
    assert bpe.encode(frame.limit(0), RANKS).count() == 0


def test_large_vocabulary_files_are_refused(tmp_path, monkeypatch):
    monkeypatch.setattr(bpe, "VOCABULARY_BYTES", 10)
    path = tmp_path / "ranks"
    path.write_bytes(b"YQ== 0\nYg== 1\n")
    with pytest.raises(ValueError, match="larger than 10 bytes"):
        bpe.read_ranks(str(path))


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def test_archives_round_trip(spark):
    big, html = "é<p>" * 90_000, "h" * 100
    rows = [
        (1, "http://a/\r\nX: y", big), (2, None, big), (None, "http://b", big), (3, "http://c", None), (4, "http://d", ""),
        (5, "u", "short"), (6, "u", "short"), (8, "u", html), (7, "u", html), (9, "u", html[1:]), (10, "u", html[1:]),
        (1, "again", big),
    ]
    got = sorted(warc.round_trip(pages(spark, rows)).collect(), key=lambda r: (r["page_id"] or 0, r["payload_bytes"]))
    assert all(r["intact"] for r in got)
    want = []
    for page_id, _, text in rows:
        data = (text or "").encode()
        refers = {big: 1, html: 7}.get(text)
        refers = None if refers == page_id else refers
        want.append((page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if refers else "response", refers))
    want.sort(key=lambda r: (r[0] or 0, r[1]))
    assert [tuple(r)[:5] for r in got] == want
    assert warc.round_trip(pages(spark, [])).count() == 0


def test_chunks_carry_digests_and_archives_are_plain(spark, monkeypatch):
    text = "0123456789" * 30_000
    folder = shared_folder(spark, "archives")
    manifest = warc.write_archives(warc.chunk_rows(warc.marked(pages(spark, [(1, "http://a", text), (2, "u", text)]))), folder)
    chunks = sorted(warc.read_chunks(manifest).where("record_type = 'response'").collect(), key=lambda r: r["chunk_no"])
    assert [len(r["data"]) for r in chunks] == [65536] * 4 + [300_000 - 4 * 65536]
    done = b""
    for r in chunks:
        done += bytes(r["data"])
        assert r["payload_digest"] == hashlib.sha256(done).hexdigest() and r["payload_bytes"] == len(done)
    assert done == text.encode()
    plain = b"".join(gzip.open(r["archive"].removeprefix("file:")).read() for r in manifest.collect())
    assert plain.count(b"WARC/1.1\r\nWARC-Type: response") == 1
    assert b"WARC-Refers-To: <urn:page:1>" in plain and b"WARC-Type: warcinfo" in plain


def test_broken_archives_are_told(spark):
    start = warc.record_start(1, "u", 5, hashlib.sha256(b"hello").hexdigest(), None)

    def read(data):
        return list(warc.read_records(io.BytesIO(data), "x"))

    whole = gzip.compress(start + b"hello\r\n\r\n")
    assert read(whole)[0][9:] == (True, True)
    assert read(gzip.compress(start + b"jello\r\n\r\n"))[0][9:] == (True, False)
    for cut in (gzip.compress(start + b"hel"), whole[:-20], gzip.compress(start[:40])):
        with pytest.raises((EOFError, zlib.error)):
            read(cut)


def test_archives_are_read_by_as_many_tasks(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 1)  # an archive for each record
    pages = spark.createDataFrame([(i, f"http://a/{i}", f"text {i} " * 30) for i in range(12)], "page_id bigint, url string, html string")
    manifest = warc.write_archives(warc.chunk_rows(warc.marked(pages)), warc.qualified(spark, str(tmp_path / "archives")))
    assert manifest.count() == 12
    chunks = warc.read_chunks(manifest).withColumn("task", F.spark_partition_id())
    assert chunks.select("task").distinct().count() == 12
    assert chunks.where("intact").count() == 12


def test_revisits_of_a_hot_page_and_of_pages_without_id(spark):
    copies = [(None if i % 50 == 0 else i, "u", "same page " * 20 if i % 3 == 0 else f"page {i} " * 20) for i in range(1, 400)]
    pages = spark.createDataFrame(copies + copies[:5], "page_id bigint, url string, html string")
    marked = warc.marked(pages)
    got = {(r["record_id"], r["payload_digest"]): r["refers_to"] for r in marked.collect()}
    first = min(i for i, _, text in copies if i is not None and text.startswith("same"))
    for i, _, text in copies:
        of = got[i, hashlib.sha256(text.encode()).hexdigest()]
        assert of == (first if text.startswith("same") and i != first else None)
    assert marked.count() == len(copies) + 5


def test_folders_have_a_scheme(spark, tmp_path):
    assert warc.qualified(spark, str(tmp_path)) == f"file://{tmp_path}"
    assert warc.qualified(spark, f"file:{tmp_path}") == f"file://{tmp_path}"


def test_short_pretokens_merge_as_long_ones(monkeypatch):
    rng = random.Random(6)
    tokens = ["".join(rng.choices("aeiounrst hcdé日'19", k=rng.randrange(2, 40))).encode()[: bpe.SHORT] for _ in range(3000)]
    tokens += [b"a" * n for n in range(2, bpe.SHORT + 3)]
    encoder, long = bpe.Encoder(RANKS, PATTERN), []
    short = [encoder.merge(t) for t in tokens]
    assert not any(encoder.low) and not any(encoder.spots)
    monkeypatch.setattr(bpe.Encoder, "merge_short", lambda self, token: long.append(token))
    monkeypatch.setattr(bpe, "SHORT", 0)
    assert short == [encoder.merge(t) for t in tokens] and not long


def test_ascii_texts_are_split_alike():
    encoder, rng = bpe.Encoder(RANKS, PATTERN), random.Random(7)
    assert encoder.ascii is not encoder.split
    letters = "".join(map(chr, range(128))) + " '\n\tstredvml019" * 4
    for _ in range(20_000):
        text = "".join(rng.choices(letters, k=rng.randrange(40)))
        assert encoder.ascii.findall(text) == encoder.split.findall(text)
    other = bpe.Encoder(RANKS, r"\p{L}+|[^\p{L}]+")
    assert other.ascii is other.split
