import json
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from blockloom.llm import lengths, packing, token_files
from blockloom.llm.tokens import Encoder
from tests.llm.conftest import prose

PATHS = {k: public_tokenizers.path(k) for k in ("byte_bpe_50k.json", "word_bpe_49k.json")}
ODD = ["", " ", "  two  spaces ", "a\n\nb", "a \n b", " lead", "trail ", "tab\tx", "don't We'LL 'tis", "x<|endoftext|>y", "ÀÉ naïve ça", "x́ é", "ΑΣ Σ", "日本語 テスト", "1,234.56 !!! ***", "a b", "\u0085x", "İstanbul", "word, word. Word.", "\x00 nul", "emoji 😀 x", "a\rb\x1cc"]


def expected(name: str, text: str, end: int) -> np.ndarray:
    tk = Tokenizer.from_file(PATHS[name])
    return np.array([*tk.encode(text or "", add_special_tokens=False).ids, end], "<u4")


@pytest.mark.parametrize("name", PATHS)
def test_encoder_equals_library(name):
    for as_text in (False, True):
        enc, tk = Encoder(PATHS[name], 50, as_text), Tokenizer.from_file(PATHS[name])
        tk.encode_special_tokens = as_text
        for text in [*ODD, prose(5, 500), " ".join(ODD), prose(5, 500)]:
            assert np.frombuffer(enc.encode(text), enc.dtype).tolist() == tk.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("name", PATHS)
def test_added_tokens_inside_texts(name):
    """As the library has it by default: the string of an added token is that token, wherever it stands."""
    with open(PATHS[name], encoding="utf-8") as f:
        added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    enc = Encoder(PATHS[name], cache=50)
    for token, i in added.items():
        for text in (token, f"a {token} b", f"a{token}b", f" {token} ", f"{token}{token}", f"One,{token}. Two", f"{token[:-1]} {token} {token.upper()}"):
            got = np.frombuffer(enc.encode(text), enc.dtype).tolist()
            assert got == Tokenizer.from_file(PATHS[name]).encode(text, add_special_tokens=False).ids and i in got, repr(text)


def test_token_files_round_trip(spark, docs, clashing, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_BYTES", 1 << 14)
    manifest = token_files.write_tokens(clashing, PATHS["byte_bpe_50k.json"], f"file://{tmp_path}", seq_len=64)
    got = sorted(token_files.read_documents(manifest).collect(), key=lambda r: (r.start))
    assert manifest.count() > 2
    want = sorted((r.doc_id is not None, r.doc_id or 0, len(ids := expected("byte_bpe_50k.json", r.text, 0)), zlib.crc32(ids.tobytes())) for r in docs.collect())
    assert sorted((g.doc_id is not None, g.doc_id or 0, g.n_tokens, g.ids_crc32) for g in got) == want
    at = 0
    for g, w in zip(got, sorted(want, key=lambda w: w[:2]), strict=True):  # ascending ids
        assert (g.doc_id is not None, g.doc_id or 0) == w[:2] and g.start == at
        at += g.n_tokens
    shard = max(manifest.collect(), key=lambda r: r.n_tokens)
    f = token_files.TokenFile(shard.path)
    whole = np.concatenate(list(f.runs()))
    for i in {0, 1, shard.n_sequences // 2, shard.n_sequences - 1}:
        ids, mask = f[i]
        assert len(ids) == len(mask) == 64 and ids[np.asarray(mask)].tolist() == whole[i * 64 : i * 64 + 64].tolist()
    with pytest.raises(IndexError):
        f[shard.n_sequences]


def test_random_access_over_batches(tmp_path):
    w = token_files.Writer(str(tmp_path / "x.arrow"), np.dtype("<u2"), seq_len=8, batch_seqs=4)
    run = np.arange(8 * 4 * 5 + 3, dtype="<u2")
    for part in np.array_split(run, 11):
        w.add(part.tobytes())
    w.close()
    f = token_files.TokenFile(str(tmp_path / "x.arrow"))
    assert [f[i][0].tolist() for i in range(20)] == run[:160].reshape(20, 8).tolist()
    assert f[20][0].tolist() == [160, 161, 162, 0, 0, 0, 0, 0] and f[20][1].true_count == 3
    ids, mask = f[3]  # inside the mapped file, not copies
    for c, at, size in ((0, ids.__array_interface__["data"][0], 16), (1, mask.buffers()[1].address, mask.buffers()[1].size)):
        whole = f.batch(0).column(c).flatten().buffers()[1]
        assert whole.address <= at and at + size <= whole.address + whole.size and not whole.is_mutable


def test_no_documents(spark, empty):
    path = PATHS["byte_bpe_50k.json"]
    assert token_files.read_documents(token_files.write_tokens(empty, path)).count() == 0
    assert packing.pack(empty, PATHS["word_bpe_49k.json"]).count() == 0
    assert lengths.suffix_sums(lengths.histogram(empty, path)).count() == 0


@pytest.mark.parametrize("window", [32, 4096])
def test_packing(spark, docs, clashing, window):
    pieces = packing.pack(clashing, PATHS["word_bpe_49k.json"], window=window, most_open=2, gap=3).collect()
    want = sorted((r.doc_id, expected("word_bpe_49k.json", r.text, 2).tobytes()) for r in docs.where("doc_id is not null and doc_id <> 10").collect())
    by_doc, by_window = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_window.setdefault(p.sequence_id, []).append(p)
        assert p.ids_crc32 == zlib.crc32(np.frombuffer(p.ids, "<u2").astype("<u4").tobytes()) and p.length == len(p.ids) // 2
    for doc_id, ids in want:
        parts = sorted(by_doc[doc_id], key=lambda p: p.start)
        assert [p.start for p in parts] == [sum(q.length for q in parts[:i]) for i in range(len(parts))]
        assert b"".join(np.frombuffer(p.ids, "<u2").astype("<u4").tobytes() for p in parts) == ids and {p.doc_tokens for p in parts} == {len(ids) // 4}
    short = 0
    for parts in by_window.values():
        parts.sort(key=lambda p: p.offset)
        assert [p.offset for p in parts] == [sum(q.length for q in parts[:i]) for i in range(len(parts))]
        short += (total := sum(p.length for p in parts)) < window - 3
        assert total <= window
    assert short <= 1


def test_packer_is_best_fit():
    p = packing.Packer(10, 2, 0, 1)
    assert not list(p.add(0, 0, 4, b"a" * 4)) and not list(p.add(1, 0, 8, b"b" * 8))
    assert [x[0] for x in next(p.add(2, 0, 2, b"c" * 2))] == [1, 2]
    assert [[x[3] for x in w] for w in p.add(3, 0, 23, b"d" * 23)] == [[b"d" * 10], [b"d" * 10]]


def test_histogram_and_suffix_sums(spark, docs, clashing):
    path = PATHS["byte_bpe_50k.json"]
    hist = lengths.histogram(clashing, path)
    n = sorted(len(expected("byte_bpe_50k.json", r.text, 0)) - 1 for r in docs.collect())
    assert sorted((r.n_tokens, r.n_docs) for r in hist.collect()) == sorted((k, n.count(k)) for k in set(n))
    sums = lengths.suffix_sums(hist)
    for r in sums.collect():
        assert r.docs_at_least == sum(x >= r.n_tokens for x in n) and r.tokens_at_least == sum(x for x in n if x >= r.n_tokens)
        assert r.truncated_total == sum(min(x, r.n_tokens) for x in n) and r["quantile"] == pytest.approx(sum(x <= r.n_tokens for x in n) / len(n))
    for limit in (1, 3, 100, 10**7):
        got = lengths.at_limit(sums, limit).first()
        assert tuple(got) == (sum(min(x, limit) for x in n), sum(max(x - limit, 0) for x in n), sum(x > limit for x in n))
    assert lengths.quantile_length(sums, 0.5).first()[0] == n[(len(n) + 1) // 2 - 1]
