import functools
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vettable.llm import queries, token_counts, token_ids, tokenise
from . import helpers as H

tokenizers = pytest.importorskip("tokenizers")
PATH = queries.tokenizer_file()


@functools.cache
def tokenizer(special_as_text):
    t = tokenizers.Tokenizer.from_file(PATH)
    t.encode_special_tokens = special_as_text
    return t


def reference(text, special_as_text=False):
    return tokenizer(special_as_text).encode(text or "", add_special_tokens=False).ids


@given(st.lists(st.integers(0, 2 ** 32 - 1), max_size=70))
@settings(deadline=None)
def test_values_round_trip(values):
    v = np.array(values, np.uint32)
    control, data = token_ids.encode_values(v)
    assert len(control) == -(-len(v) // 4)
    assert token_ids.decode_values(control, data, len(v)).tolist() == values


def test_blocks_round_trip():
    raw = token_ids.encode_block([5, None, 7], [np.array([1, 70000]), np.array([], int), np.array([300])]) + b"\n"
    raw += token_ids.encode_block([], []) + b"\n"
    (a, n, v), (b, m, w) = token_ids.decode_blocks(raw)
    assert (a, n.tolist(), v.tolist()) == ([5, None, 7], [2, 0, 1], [1, 70000, 300])
    assert (b, m.tolist(), w.tolist()) == ([], [], [])
    with pytest.raises(ValueError):
        list(token_ids.decode_blocks(raw[:-1] + b"x"))


@given(st.lists(st.text(alphabet=" \n\tab,.'éZ1 　\x1c漢", max_size=40), max_size=6))
@settings(deadline=None, max_examples=150)
def test_pieces_give_the_ids_of_whole_texts(texts):
    enc = tokenise.worker_encoder(tokenise.read_definition(PATH), False)
    texts += ["a <|endoftext|>  b", "don't stop, ok.", " lead", "end "]
    got = [np.frombuffer(x, "<u2").tolist() for x in enc.encode(texts)]
    assert got == [reference(t) for t in texts]


def expected_files(pairs):
    out, start = [], 0
    order = sorted(((d, t) for d, t in pairs), key=lambda p: (p[0] is not None, p[0] or 0))
    for d, t in order:
        ids = reference(t) + [2]
        out.append([d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())])
        start += len(ids)
    return out


def test_token_files_of_documents(spark):
    docs = H.documents(spark)
    got = queries.op5_token_ids(spark, H.SF)
    want = expected_files(H.rows(docs, "doc_id", "text"))
    assert sorted(map(list, H.rows(got, "doc_id", "start", "n_tokens", "ids_crc32"))) == sorted(want)


def test_token_files_of_awkward_rows(spark):
    got = token_ids.token_id_output(H.awkward(spark), PATH, 2).collect()
    assert sorted((r["n_tokens"], r["ids_crc32"]) for r in got) == sorted(
        (n, c) for _, _, n, c in expected_files(H.AWKWARD))
    assert sorted((r["doc_id"] is not None, r["doc_id"]) for r in got) == sorted(
        (d is not None, d) for d, _ in H.AWKWARD)
    # Positions: every document starts where those before it end.
    ends = sorted((r["start"], r["n_tokens"]) for r in got)
    assert [s for s, _ in ends] == [sum(n for _, n in ends[:i]) for i in range(len(ends))]
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])][:3] == [None, None, -9]
    assert token_ids.token_id_output(H.empty(spark), PATH, 2).collect() == []


def test_token_counts(spark):
    docs = H.documents(spark).union(H.awkward(spark).select("doc_id", "text", F.lit(None), F.lit(None), F.lit(None)))
    got = token_counts.token_counts(docs, PATH, "<|endoftext|>")
    want = [(d, len(reference(t, True))) for d, t in H.rows(docs, "doc_id", "text")]
    key = lambda r: (r[0] is not None, r)
    assert sorted(H.rows(got, "doc_id", "n_tokens"), key=key) == sorted(want, key=key)
    assert token_counts.token_counts(H.empty(spark), PATH, "<|endoftext|>").collect() == []
    with pytest.raises(ValueError):
        token_counts.token_counts(docs, PATH, "the")


@pytest.mark.parametrize("block", [1, 2, 3, 5, 100])
def test_scan_stitches_documents_across_blocks(spark, tmp_path, block):
    rng = np.random.default_rng(block)
    files = [rng.integers(7, 11, n).tolist() for n in (0, 1, 9, 40)] + [[7], [8, 8, 8], [7, 7, 7], [8] * 9 + [7]]
    for i, ids in enumerate(files):
        (tmp_path / f"part-{i:05d}-x.c000.txt").write_bytes(np.array(ids, "<u2").tobytes())
    got = H.rows(token_counts.separator_scan(spark, str(tmp_path), 7, 2, block), "part", "ordinal", "start", "n_tokens")
    want = []
    for i, ids in enumerate(files):
        at = [k for k, x in enumerate(ids) if x == 7]
        ends = at + [len(ids)] if ids and ids[-1] != 7 else at
        for k, e in enumerate(ends):
            s = ends[k - 1] + 1 if k else 0
            want.append((i * 1_000_000, k, s, e - s))
    assert sorted(got) == sorted(want)


def test_a_folder_decodes_by_itself(spark):
    docs = spark.createDataFrame([(2, "second text"), (1, "first one, the first"), (3, None)], "doc_id long, text string")
    path = token_ids.write_token_files(docs, PATH, 2)
    vocabulary, end_id, digest = token_ids.read_ranks(spark.newSession(), path)
    assert end_id == 2 and len(digest) == 64 and sorted(vocabulary.tolist()) == list(range(len(vocabulary)))
    read = token_ids.read_token_files(spark.newSession(), path)
    assert sorted(map(list, read.collect())) == expected_files(H.rows(docs, "doc_id", "text"))


def test_the_memo_keeps_two_generations(monkeypatch):
    monkeypatch.setattr(tokenise, "MEMO_PIECES", 3)
    enc = tokenise.PieceEncoder(tokenise.read_definition(PATH), False)
    for t in ["one two three, four.\nFive six", "Éins zwei.\nDrei. one", "x\ny one two\n three four", "Five .\n six;seven"] * 3:
        assert [np.frombuffer(x, "<u2").tolist() for x in enc.encode([t])] == [reference(t)]


@given(st.lists(st.text(alphabet=" \n\n\t\r\x0b\x1c\x85\xa0\u1680\u180e\u2003\u2028\u202f\u205f\u3000\u200b\ufeffabsZ,.'!1\u00b2é\u0301漢😀",
                        max_size=30), max_size=8))
@settings(deadline=None, max_examples=200)
def test_cuts_and_joins_keep_the_ids_of_whole_texts(texts):
    enc = tokenise.worker_encoder(tokenise.read_definition(PATH), False)
    for part in (texts, [t.replace(" ", " Été, it's\nNo ") for t in texts] + ["", "x<|endoftext|>y z"]):
        assert [np.frombuffer(x, "<u2").tolist() for x in enc.encode(part)] == [reference(t) for t in part]


def test_new_pieces_reach_the_tokenizer_joined_and_once(monkeypatch):
    letters = "abcdefgh"
    words = [a + b + c + d + "q" for a in letters for b in letters for c in letters for d in letters]
    text = "start " + " ".join(w + m for w, m in zip(words, ["", ",", ".", ".\nNext"] * len(words)))
    enc, asked = tokenise.PieceEncoder(tokenise.read_definition(PATH), False), []
    whole = enc._whole
    monkeypatch.setattr(enc, "_whole", lambda texts: asked.extend(texts) or whole(texts))
    assert [np.frombuffer(x, "<u2").tolist() for x in enc.encode([text, None, text])] == [reference(text), [], reference(text)]
    assert sorted(w for t in asked for w in t.split() if w in set(words)) == words
    assert len(asked) < len(words) // 32
    asked.clear()
    enc.encode([text])
    assert asked == []


def test_texts_wider_than_a_window_of_cuts(monkeypatch):
    monkeypatch.setattr(tokenise, "CUT_BYTES", 7)
    monkeypatch.setattr(tokenise, "OUT_PIECES", 3)
    monkeypatch.setattr(tokenise, "JOINED", 2)
    enc = tokenise.PieceEncoder(tokenise.read_definition(PATH), False)
    texts = ["a \u3000 b\u2003 c\nd\n\ne", "", "Été à la mer, it's 12th.\nNext  one\u00a0 two " * 5, " ", "\nx"]
    assert [np.frombuffer(x, "<u2").tolist() for x in enc.encode(texts)] == [reference(t) for t in texts]
