"""Token counts, token files and packing against the library."""

import random
import zlib

import numpy as np
import pytest

from strandline.llm import packing, pieces, token_counts, token_files, wavelet
from strandline.llm.queries import tokenizer_path

tokenizers = pytest.importorskip("tokenizers")
BYTE, WORD = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")
PARTS = ["a", "B", "é", "Ç", "×", " ", "  ", "\n", ".", ",", "'", "'s", "'T", "1", "\t", "\u00a0", "\u0301", "ß", "Я", "中", "<|endoftext|>", "<|startoftext|>", "!", "|", "\x1c", "\x85", "\u2003", "Σ", " the", " of", "\r\n", "İ", "\u200b", "don't. "]


def texts(n=600, seed=1):
    rng = random.Random(seed)
    return ["", " ", "x"] + ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def library(path):
    tok = tokenizers.Tokenizer.from_file(path)
    return lambda batch: [e.ids for e in tok.encode_batch(batch, add_special_tokens=False)]


@pytest.mark.parametrize("path", [BYTE, WORD])
@pytest.mark.parametrize("memo", [0, 1000])
def test_pieces_give_the_library_s_ids(path, memo):
    enc, batch = pieces.PieceEncoder(path, memo), texts()
    want = library(path)(batch)
    for _ in range(2):
        n, ids = enc.encode([t.encode() for t in batch])
        assert n.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    assert len(enc.memo) <= memo


def test_long_texts_are_cut_safely(monkeypatch):
    monkeypatch.setattr(pieces, "CHUNK_BYTES", 64)
    text = " ".join("word" * (i % 3 + 1) + ("," if i % 5 == 0 else "") for i in range(300)) + "nospace" * 40
    assert len(pieces.split_long(text.encode(), 64)) > 5
    assert b"".join(pieces.split_long(text.encode(), 64)) == text.encode()
    n, ids = pieces.PieceEncoder(BYTE).encode([text.encode(), b"", text.encode()])
    want = library(BYTE)([text])[0]
    assert ids.tolist() == want * 2 and n.tolist() == [len(want), 0, len(want)]


def rows():
    out = [(i, t, "x", 5) for i, t in enumerate(texts(200, 3))]
    return out + [(None, "no id", "x", 1), (3, None, "x", 1), (3, "same id", "x", 1), (3, "same id", "x", 1), (-5, "word " * 3000, "x", 1)]


SCHEMA = "doc_id long, text string, name string, n_tokens long"


def test_counts(spark):
    got = sorted(map(str, map(tuple, token_counts.count_tokens(spark.createDataFrame(rows(), SCHEMA), BYTE).collect())))
    want = library(BYTE)([r[1] or "" for r in rows()])
    assert got == sorted(str((r[0], len((r[1] or "").encode()), len(w), len(w) > 1024)) for r, w in zip(rows(), want, strict=True))
    assert token_counts.count_tokens(spark.createDataFrame([], SCHEMA), BYTE).count() == 0


@pytest.mark.parametrize("shard", [50, 1 << 20])
def test_token_files(spark, tmp_path, shard):
    folder = f"file://{tmp_path}/t"
    manifest = token_files.write_tokens(spark.createDataFrame(rows(), SCHEMA), WORD, folder, shard_ids=shard)
    got = [tuple(r) for r in token_files.read_tokens(folder, manifest).collect()]
    ordered = rows()
    ids = {id(r): [*x, 1] for r, x in zip(ordered, library(WORD)([r[1] or "" for r in ordered]), strict=True)}
    ordered.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    want, start = [], 0
    for r in ordered:
        own = ids[id(r)]
        want.append((r[0], start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        start += len(own)
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert (manifest.count() > 10) == (shard == 50)


def test_only_files_of_the_manifest_are_read(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    manifest = token_files.write_tokens(spark.createDataFrame(rows(), SCHEMA), WORD, folder, shard_ids=2000)
    n, name = manifest.count(), manifest.first()["name"]
    assert n > 2
    (tmp_path / "t" / "9999999-0000000.wm").write_bytes((tmp_path / "t" / name).read_bytes())
    assert token_files.read_tokens(folder, manifest).count() == len(rows())
    (tmp_path / "t" / name).unlink()
    with pytest.raises(Exception, match=name):
        token_files.read_tokens(folder, manifest).collect()


def test_no_token_files(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    assert token_files.read_tokens(folder, token_files.write_tokens(spark.createDataFrame([], SCHEMA), WORD, folder)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000])
def test_wavelet_matrix(n):
    rng = np.random.default_rng(n)
    ids = rng.choice(np.array([0, 1, 5, 77, 49_407]), n).astype(np.uint16)
    data = wavelet.dump(ids, [1, None], np.array([n, 0]), 16)
    w, docs, lengths = wavelet.load(data)
    assert (w.decode() == ids).all() and docs == [1, None] and lengths.tolist() == [n, 0]
    for i in rng.integers(0, max(n, 1), 20) if n else []:
        assert w.access(int(i)) == ids[i]
    for s in (0, 1, 5, 77, 78, 49_407, 70_000):
        at = np.flatnonzero(ids == s)
        assert w.count(s) == len(at)
        a, b = n // 3, n - n // 4
        assert w.count(s, a, b) == ((at >= a) & (at < b)).sum()
        assert [w.select(s, k) for k in range(len(at))] == at.tolist() and w.select(s, len(at)) == w.select(s, -1) == -1
    with pytest.raises(ValueError):
        wavelet.load(data[:-1] + bytes([data[-1] ^ 1]))


@pytest.mark.parametrize("shard", [500, 1 << 20])
def test_packing(spark, shard):
    got = packing.pack(spark.createDataFrame(rows(), SCHEMA), BYTE, window=128, shard_tokens=shard).toPandas()
    ids = [[*x, 0] for x in library(BYTE)([r[1] or "" for r in rows()])]
    want = sorted((str(r[0]), len(x)) for r, x in zip(rows(), ids, strict=True))
    first = got[got["start"] == 0]
    key = lambda d: "None" if d != d else str(int(d))
    assert sorted((key(d), n) for d, n in zip(first["doc_id"], first["doc_tokens"], strict=True)) == want
    assert got["length"].sum() == sum(map(len, ids)) and (got["length"] > 0).all()
    for r, x in zip(rows(), ids, strict=True):
        if r[0] not in (3, None):
            own = got[got["doc_id"] == r[0]].sort_values("start")
            assert (own["start"] == own["length"].cumsum() - own["length"]).all() and own["length"].sum() == len(x)
            assert all(c == zlib.crc32(np.array(x[s : s + n], "<u4").tobytes()) for s, n, c in zip(own["start"], own["length"], own["ids_crc32"], strict=True))
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        n = s["length"].sum()
        assert (s["offset"] == s["length"].cumsum() - s["length"]).all() and n <= 128 and (n == 128 or n & (n - 1) == 0)
    assert packing.pack(spark.createDataFrame([], SCHEMA), BYTE).count() == 0


def test_neighbours_fill_a_seed_s_window():
    rng = np.random.default_rng(1)
    topic = [rng.integers(100 * t, 100 * t + 100, 30) for t in range(5) for _ in range(8)]
    order = rng.permutation(40)
    docs = [topic[i] for i in order]
    df = np.zeros(500, np.int64)
    for d in docs:
        df[np.unique(d)] += 1
    index = packing.ShardIndex(docs, df, 40, 30.0)
    same = total = 0
    for pieces_ in packing.pack_shard(docs, index, 120):
        kinds = [order[d] // 8 for d, _, _ in pieces_]
        same += sum(k == kinds[0] for k in kinds[1:])
        total += len(kinds) - 1
    assert same / total > 0.6


def test_neighbours_are_those_of_brute_force_bm25():
    """Every unused document in the order of its score, over all tokens, then the rest in order; also for tokens that most documents have."""
    rng = np.random.default_rng(4)
    docs = [rng.integers(0, 12 if i % 3 else 60, rng.integers(1, 25)) for i in range(60)] + [np.array([900])] * 3
    df = np.zeros(1000)
    for d in docs:
        df[np.unique(d)] += 1
    mean = sum(map(len, docs)) / len(docs)

    def score(query, doc):
        out = 0.0
        for t in set(query.tolist()):
            tf = int((doc == t).sum())
            idf = np.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5))
            out += max(idf, 1e-6) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len(doc) / mean)) if tf else 0.0
        return out

    for seed in (0, 7, 61):
        index = packing.ShardIndex(docs, df, len(docs), mean, terms=1000)
        index.used[[seed, 3]] = True
        got = []
        for d in index.neighbours(seed, most=5):
            index.used[d] = True
            got.append(d)
        left = [d for d in range(len(docs)) if d not in (seed, 3)]
        of = {d: score(docs[seed], docs[d]) for d in left}
        hits = [d for d in left if of[d] > 0]
        assert set(got[: len(hits)]) == set(hits) and got[len(hits) :] == [d for d in left if d not in hits]
        assert all(of[a] > of[b] - 1e-9 for a, b in zip(got[: len(hits)], got[1 : len(hits)], strict=False))  # sums in another order


def test_a_crowded_place_weighs_as_one(spark):
    copies = [(i, "one text that many rows share again and again", "x", 1) for i in range(3000)]
    others = [(10_000 + i, " ".join(hex(7919 * i + 31 * k) for k in range(12)) + " alone", "x", 1) for i in range(20)]
    encoded = packing.encode(spark.createDataFrame(copies + others, SCHEMA), BYTE, 0)
    df, n_docs, _ = packing.document_frequencies(encoded, 50_257, 2)
    again = library(BYTE)([" again"])[0][0]
    alone = library(BYTE)([" alone"])[0][0]
    assert df[again] == pytest.approx(1, abs=0.01) and 10 < df[alone] <= 20 and df[alone] < n_docs < 22  # some of few texts may share a place by chance
