from hypothesis import given, settings
from hypothesis import strategies as st

from sieveflow.llm import pieces
from sieveflow.llm import sentpiece as S

from .helpers import docs, empty, rows

V = pieces.load()


def brute(chunk):
    """All segmentations, best first."""
    out = []

    def go(i, ids, score):
        if i == len(chunk):
            out.append((score, ids))
            return
        for j in range(i + 1, len(chunk) + 1):
            if chunk[i:j] in V.ids:
                go(j, (*ids, V.ids[chunk[i:j]]), score + V.scores[chunk[i:j]])
        if chunk[i] not in V.ids:
            c = "▁" if chunk[i] == "\0" else chunk[i]
            own = tuple(V.bytes_[b] for b in c.encode())
            go(i + 1, ids + own, score + V.unknown * len(own))

    go(0, (), 0.0)
    return sorted(out, key=lambda x: -x[0])


def spaced(text):
    return text.replace("▁", "\0").replace(" ", "▁")


@settings(max_examples=40, deadline=None)
@given(st.text("abehtin, .!é日▁\n", min_size=1, max_size=9))
def test_nbest_is_that_of_all_segmentations(text):
    want = brute(spaced(" " + text))
    got = S.lattice_nbest(spaced(" " + text), V, 4)
    assert [s for s, _ in got] == [s for s, _ in want[:4]]
    assert len({ids for _, ids in got}) == len(got)
    score, ids, loss = S.best_and_loss(spaced(" " + text), V)
    assert score == want[0][0] and (len(want) < 2 or loss == want[0][0] - want[1][0])


@settings(max_examples=60, deadline=None)
@given(st.text("abehtin, .!’”é日▁\n", max_size=12))
def test_chunks_give_the_nbest_of_the_whole_lattice(text):
    e = S.Encoder(pieces.PIECE_FILE, 3)
    ids, best = e.encode(text)
    assert e.decode(ids) == text
    if text:
        want = S.lattice_nbest(spaced(" " + text), V, 3)
        assert [s for s, *_ in best] == [s for s, _ in want]
        check_edits(e, ids, best, text)


def check_edits(e, ids, best, text):
    """Each segmentation spells the text, weighs what its score says, and differs from the others."""
    every = []
    for score, n, edits in best:
        own = ids.tolist()
        for start, length, new in reversed(edits):
            own[start : start + length] = new
        assert len(own) == n and e.decode(own) == text and abs(float(e.weight[own].sum()) - score) < 1e-6
        every.append(tuple(own))
    assert len(set(every)) == len(every)


def test_ids_of_all_segmentations(spark):
    df = S.encode(docs(spark)).withColumn("every", S.nbest_ids())
    e = S.Encoder(pieces.PIECE_FILE, 3)
    texts = {repr(r.text) for r in docs(spark).collect()}
    for r in df.collect():
        if r.ids is not None:
            assert r.every[0] == r.ids and [len(x) for x in r.every] == r.nbest_pieces and len(set(map(tuple, r.every))) == len(r.every)
            assert {repr(e.decode(x)) for x in r.every} <= texts and len({e.decode(x) for x in r.every}) == 1
            assert all(abs(float(e.weight[x].sum()) - s) < 1e-6 * max(1, -s) for x, s in zip(r.every, r.scores, strict=True) if x)


def test_documents_round_trip(spark):
    got = S.encode(docs(spark, extra=True), keep=("doc_id", "n"))
    assert got.columns[:2] == ["doc_id", "n"]
    back = S.decode(got).collect()
    assert sorted(map(repr, [(r.doc_id, r.text) for r in back])) == sorted(map(repr, [(r[0], r[1]) for r in rows()]))
    for r in got.collect():
        assert r.round_trip in (True, None)
        if r.ids is not None:
            assert r.n_pieces == len(r.ids) == r.nbest_pieces[0] and r.scores == sorted(r.scores, reverse=True)


def test_empty(spark):
    assert S.encode(empty(spark)).collect() == []
    assert S.Encoder(pieces.PIECE_FILE, 2).encode("")[1] == [(0.0, 0, ())]


def test_generations_of_kept_chunks(monkeypatch):
    monkeypatch.setattr(S, "_KEPT_BYTES", 600)
    e = S.Encoder(pieces.PIECE_FILE, 2)
    text = "one two three four five one two three one"
    ids, _ = e.encode(text)
    assert e.decode(ids) == text and len(e.new) <= 3


@settings(max_examples=60, deadline=None)
@given(st.text("abeht=日本A9", min_size=30, max_size=60))
def test_long_chunks_are_cut_where_no_piece_goes_across(text):
    import unittest.mock as mock

    with mock.patch.object(S, "_LONG", 8):
        e = S.Encoder(pieces.PIECE_FILE, 3)
        ids, best = e.encode(text)
    assert e.decode(ids) == text
    want = S.lattice_nbest(spaced(" " + text), V, 3)
    assert [round(s, 9) for s, *_ in best] == [round(s, 9) for s, _ in want]
    check_edits(e, ids, best, text)


def test_long_runs_without_spaces_take_little_memory():
    import tracemalloc

    e = S.Encoder(pieces.PIECE_FILE, 3)
    tracemalloc.start()
    for text in ("日本語の文書" * 20_000, "QmFzZTY0" * 15_000, "a" * 50_000):
        ids, best = e.encode(text)
        assert e.decode(ids) == text and 1 <= len(best) <= 3
    assert tracemalloc.get_traced_memory()[1] < 150 << 20
    tracemalloc.stop()
    kept = sum(S._ENTRY + len(c) + len(x) for c, x in e.new.items())
    assert kept <= S._KEPT_BYTES and max(map(len, e.new)) <= S._LONG
