import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer

from conftest_helpers import by_id
from marginalia.llm import nbest, token_counts, token_store
from marginalia.llm.queries import BYTE_BPE, PIECE_BPE, WORD_BPE

PARTS = ["a", "Bar", "é", " ", "\n", "\t", "\r", "'s", "12", "²", "!", "<|endoftext|>", "<|startoftext|>", " x", "  ", "日本", "_", "don't", "\x85", "\xa0", "\x1c", "word,", "Straße", "ΑΣ", "ﬁ", "#$%"]


@pytest.fixture
def rows(dice):
    texts = ["".join(dice.choices(PARTS, k=dice.randint(0, 12))) for _ in range(300)]
    out = [(i, t) for i, t in enumerate(texts)] + [(None, "x y"), (7, None), (7, ""), (7, ""), (400, "word " * 30_000)]
    return out


def test_token_counts(documents, rows):
    tokenizer = Tokenizer.from_file(WORD_BPE)
    wanted = by_id((d, len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for d, t in rows)
    for size in (5, 20_000):
        found = token_counts.token_counts(documents(rows), WORD_BPE, table_size=size, summary_size=8, cache_size=20).collect()
        assert by_id((r.doc_id, r.n_bytes, r.n_tokens) for r in found) == wanted
        assert all(r.over_limit == (r.n_tokens > 2048) for r in found)
    assert token_counts.token_counts(documents([]), WORD_BPE).count() == 0


def test_tokenizers_that_keep_white_space_are_refused():
    with pytest.raises(ValueError, match="white space"):
        token_counts.checked_tokenizer(BYTE_BPE)


def test_misra_gries():
    from collections import Counter

    counts = Counter({"a": 10, "b": 7, "c": 2, "d": 1})
    assert token_counts.pruned(counts, 2) == {"a": 8, "b": 5}
    assert token_counts.pruned(counts, 9) == counts


def test_token_store(spark, documents, rows, tmp_path):
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    path = f"file://{tmp_path}/store"
    token_store.write_store(documents(rows), path, BYTE_BPE, mean_chunk=32, max_chunk=100)
    ids = [(d, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]) for d, t in rows]
    found = token_store.read_documents(spark, path, BYTE_BPE).collect()
    assert by_id((r.doc_id, r.ids) for r in found) == by_id(ids)
    digests = token_store.read_digests(spark, path, BYTE_BPE).orderBy("start").collect()
    assert all(r.verified for r in digests)
    assert by_id((r.doc_id, r.n_tokens, r.ids_crc32) for r in digests) == by_id((d, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, x in ids)
    assert [r.doc_id for r in digests] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
    assert [r.start for r in digests] == np.cumsum([0, *(r.n_tokens for r in digests)]).tolist()[:-1]
    stored = token_store.chunks(spark, path)
    assert stored.count() == stored.select("digest").distinct().count()
    manifest = spark.read.parquet(f"{path}/manifest").collect()
    assert sum(m.n_docs for m in manifest) == len(rows) and sum(m.n_ids for m in manifest) == sum(len(x) for _, x in ids)


def test_empty_store(spark, documents, tmp_path):
    path = f"file://{tmp_path}/store"
    token_store.write_store(documents([]), path, BYTE_BPE)
    assert token_store.read_digests(spark, path, BYTE_BPE).count() == 0


def test_cuts_depend_on_content_alone():
    ids = np.random.default_rng(3).integers(0, 50_000, 5000)
    a = token_store.cut_points(ids, np.array([5000]), 64, 10_000)[0]
    b = token_store.cut_points(np.concatenate([ids[:777], ids]), np.array([777, 5777]), 64, 10_000)[1]
    assert [x + 777 for x in a] == b and len(a) > 30


def test_joined_crc():
    data = np.random.default_rng(4).bytes(5000)
    cuts = [0, 1, 17, 1000, 1000, 4096, 5000]
    assert token_store.joined_crc([(zlib.crc32(data[i:j]), j - i) for i, j in zip(cuts, cuts[1:])]) == zlib.crc32(data)


def all_paths(model, text):
    if not text:
        return [(0.0, ())]
    out = []
    for end in range(1, min(len(text), 16) + 1):
        if piece := model.scores.get(text[:end]):
            out += [(piece[0] + s, (piece[1], *i)) for s, i in all_paths(model, text[end:])]
    if text[0] not in model.scores:
        own = tuple(model.byte_ids[b] for b in text[0].encode())
        out += [(model.unknown + s, own + i) for s, i in all_paths(model, text[1:])]
    return out


@pytest.mark.parametrize("text", ["hello wo", "a\nb  c", "", "  x", "die Üb€", "▁a ", " \n ", "aaaaaaa", "to, it."])
def test_n_best_against_all_segmentations(text):
    model = nbest.loaded(PIECE_BPE)
    wanted = sorted((s for s, _ in all_paths(model, " " + text)), reverse=True)[:6]
    found = model.n_best(text, 6)
    # sums of logarithms, in another order
    assert [s for s, _ in found] == pytest.approx(wanted, abs=1e-9)
    assert len({i for _, i in found}) == len(found)
    assert all(model.decode(i) == text for _, i in found)
    score_of = {i: s for s, i in all_paths(model, " " + text)}
    assert [score_of[i] for _, i in found] == pytest.approx([s for s, _ in found], abs=1e-9)
    assert model.best_paths(" " + text, 6)[0][0] == pytest.approx(wanted[0], abs=1e-9)


def test_log_probabilities():
    found = nbest.log_probabilities({"a": (-0.0, 1), "b": (-1.0, 2), "ab": (-2.0, 3)})
    assert sum(np.exp(s) for s, _ in found.values()) == pytest.approx(1) and found["a"][0] > found["b"][0] > found["ab"][0]
    unigram = {"a": (-1.5, 1), "b": (-2.25, 2)}
    assert nbest.log_probabilities(unigram) is unigram


@pytest.mark.parametrize("filler", ["{} " * 250, "{}." * 250 + " I "])
def test_n_best_when_the_part_that_loses_least_comes_last(filler):
    """Before it come more parts of equal loss than any N best need, in words of their own or in a single chunk."""
    model = nbest.loaded(PIECE_BPE)
    words = sorted(["hello", "world", "language", "segment", "morning", "nothing"], key=lambda w: model._known(" " + w)[1])
    text = filler.format(*[words[-1]] * 250) + words[0]
    wanted = [s for s, _ in model.best_paths(" " + text, 4)]
    for n in (2, 4):
        assert model.encode(text, n)[1] == pytest.approx(wanted[:n], abs=1e-6)
        assert [s for s, _ in model.n_best(text, n)] == pytest.approx(wanted[:n], abs=1e-6)


def test_the_parts_that_lose_least(dice):
    model = nbest.Pieces(PIECE_BPE)
    losses = dict(zip([f" {w}" for w in "abcdefgh"], [1.0, 2.0, 2.0, 3.0, 4.0, 5.0, 5.0, float("inf")]))
    model.parts = {part: (0.0, loss, b"") for part, loss in losses.items()}
    for _ in range(200):
        keys = dice.choices("eh", k=dice.choice([0, 5, 600])) + dice.choices("abcdefgh", k=dice.choice([1, 2, 5]))
        found = [losses[f" {key}"] for key in keys]
        wanted = sorted((loss, at, 0, f" {key}") for at, (key, loss) in enumerate(zip(keys, found)) if loss < float("inf"))
        assert model._near(found, keys, 3) == wanted[:3]


def test_pieces_are_those_of_the_library():
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    model = nbest.loaded(PIECE_BPE)
    for text in ("Hello world", "naïve 日本", "tab\tend"):
        assert library.decode(list(model.n_best(text, 1)[0][1])) == text


def test_encoding_and_decoding(documents, rows):
    made = nbest.encoded(documents(rows), PIECE_BPE)
    found = made.collect()
    model = nbest.loaded(PIECE_BPE)
    texts = {}
    for doc, text in rows:
        texts.setdefault(doc, set()).add(text or "")
    for r in found:
        known = [[zlib.crc32(np.array(i, "<u4").tobytes()) for _, i in model.n_best(t, nbest.N_BEST)] for t in texts[r.doc_id]]
        assert r.n_best_crc32 in known and r.ids_crc32 == r.n_best_crc32[0]
    assert all(r.round_trip and r.n_pieces == len(r.ids) and r.n_best_scores == sorted(r.n_best_scores, reverse=True) for r in found)
    back = nbest.decoded(made, PIECE_BPE).collect()
    assert by_id((r.doc_id, r.text) for r in back) == by_id((d, t or "") for d, t in rows)
    assert nbest.encoded(documents([]), PIECE_BPE).count() == 0


def test_tokenizer_paths_are_parameters():
    assert WORD_BPE == public_tokenizers.path("word_bpe_49k.json")


def parquet_files(path, name):
    return sorted(p for p in (path / "store" / name).rglob("*.parquet"))


@pytest.fixture
def store(spark, documents, tmp_path):
    token_store.write_store(documents([(i, f"text number {i} of " + "many words " * (i % 9)) for i in range(60)]), f"file://{tmp_path}/store", BYTE_BPE, mean_chunk=8, max_chunk=30)
    return tmp_path


def digests(spark, store):
    return token_store.read_digests(spark, f"file://{store}/store", BYTE_BPE).collect()


def test_lost_recipes_are_reported(spark, store):
    lost = max(parquet_files(store, "recipes"), key=lambda p: p.stat().st_size)
    n = spark.read.parquet(f"file://{lost}").count()
    lost.rename(store / "lost")
    found = digests(spark, store)
    assert len(found) == 60 and sum(not r.verified for r in found) == n > 0
    assert all(r.doc_id is None and r.n_tokens is None for r in found if not r.verified)


def test_a_shortened_recipe_is_reported(spark, store):
    """One whose own root fits what is left of it, so that only the manifest can tell."""
    file = max(parquet_files(store, "recipes"), key=lambda p: p.stat().st_size)
    table = pq.read_table(file)
    rows = table.to_pylist()
    at = next(i for i, r in enumerate(rows) if len(r["recipe"]) > token_store._DIGEST)
    cut = rows[at]["recipe"][: token_store._DIGEST]
    chunk = spark.createDataFrame([(bytearray(cut),)], "digest binary").join(token_store.chunks(spark, f"file://{store}/store"), "digest").first()
    rows[at] |= {"recipe": cut, "root": token_store.merkle_root([cut]), "n": chunk.n}
    (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
    pq.write_table(pa.Table.from_pylist(rows, table.schema), file)
    found = {r.doc_id: r.verified for r in digests(spark, store)}
    assert len(found) == 60 and not found[rows[at]["doc_id"]]
    assert {d for d, ok in found.items() if not ok} == {r["doc_id"] for r in rows if r["part"] == rows[at]["part"]}


def test_lost_and_changed_chunks_are_reported(spark, store):
    before = token_store.chunks(spark, f"file://{store}/store").collect()
    file = max(parquet_files(store, "objects/kind=chunk"), key=lambda p: p.stat().st_size)
    rows = pq.read_table(file).to_pylist()
    needed = {r.doc_id: {r.recipe[i : i + token_store._DIGEST] for i in range(0, len(r.recipe), token_store._DIGEST)} for r in token_store.recipes(spark, f"file://{store}/store").collect()}
    other = next(r for r in before if r.digest != rows[0]["digest"] and r.n == rows[0]["n"])
    gone = rows[0]["digest"]
    rows[0]["payload"] = bytes(other.payload)
    (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
    pq.write_table(pa.Table.from_pylist(rows, pq.read_schema(file)), file)
    assert {r.doc_id for r in digests(spark, store) if not r.verified} == {d for d, x in needed.items() if gone in x} != set()
    file.rename(store / "lost")
    lost = {r["digest"] for r in rows}
    assert {r.doc_id for r in digests(spark, store) if not r.verified} == {d for d, x in needed.items() if x & lost}
