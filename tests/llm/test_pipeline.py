import corpus_pipeline as P

from sieveflow.llm import pieces
from sieveflow.llm import sentpiece as S

from .test_line_dedup import brute as line_brute
from .test_mixing import targets


def test_stages_against_plain_versions(spark, sf):
    """Each stage on its own input; the classifier's is what its operator says, the others are recomputed."""
    from sieveflow.llm import quality, simhash
    from sieveflow.llm.common import cut

    from .helpers import components

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    seen = [docs]
    for name, stage in P.STAGES:
        docs = cut(stage(spark, docs, sf), name)
        seen.append(docs)
    assert all(d.columns == columns for d in seen[:-1])

    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good = {r.doc_id for r in quality.classify(seen[0], labels).collect() if r.predicted}
    assert {r.doc_id for r in seen[1].collect()} == good

    before = sorted((r.doc_id, r.text) for r in seen[1].collect())
    dropped = {i for i, t in before if t.strip()}
    want = {i: t for i, t in line_brute(before)}
    got = {r.doc_id: (r.text, r.n_chars) for r in seen[2].collect()}
    assert got == {i: (t, len(t)) for i, t in want.items() if t.strip() or i not in dropped}

    sets = {r.doc_id: set(simhash.shingle_hashes(r.text).tolist()) for r in seen[2].collect()}
    alike = lambda a, b: sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    comp = components(sorted(sets), alike)
    assert sorted(r.doc_id for r in seen[3].collect()) == sorted(i for i in comp if comp[i] == i)

    sizes: dict = {}
    for r in seen[3].collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.split())
    taken: dict = {}
    for r in seen[4].collect():
        taken[r.source] = taken.get(r.source, 0) + len(r.text.split())
    most = max(len(r.text.split()) for r in seen[3].collect())
    assert all(abs(taken.get(s, 0) - t) <= most for s, t in targets(sizes).items())

    e = S.Encoder(pieces.PIECE_FILE, 3)
    texts = {r.doc_id: r.text for r in seen[4].collect()}
    final = seen[5].collect()
    assert sorted(r.doc_id for r in final) == sorted(r.doc_id for r in seen[4].collect())
    assert all(r.round_trip and e.decode(r.ids) == texts[r.doc_id] for r in final)


def test_run(spark, sf):
    assert P.run(spark, sf).count() > 0


def test_cases_of_all_stages(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows and columns with the names that operators use inside, through every stage."""
    from pyspark.sql import functions as F

    from sieveflow.llm.common import cut

    from .helpers import LONG, docs, empty

    inside = ("_lines", "_dropped", "n_lines", "gone_id", "again_id", "mix_id", "copies", "row", "own", "comp", "node", "fp", "hashes", "stats", "s", "t", "rate", "times", "bucket", "lam", "line", "first")
    table = docs(spark).withColumns({c: F.lit(c) for c in inside})
    labels = spark.createDataFrame([(0, 1, 0), (6, 0, 0), (8, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for start in (table, empty(spark).withColumns({c: F.lit(c) for c in inside})):
        for k, (name, stage) in enumerate(P.STAGES):
            now = cut(stage(spark, start, str(tmp_path)), name)  # each stage on all rows
            got = now.collect()
            if start is not table:
                assert got == []
                continue
            if k < len(P.STAGES) - 1:
                assert now.columns == table.columns
                assert all(r[c] == c for r in got for c in inside)
            ids = [r.doc_id for r in got]
            if name == "line_dedup":
                assert {3, 4, 99, None} >= {r.doc_id for r in got if not r.text} >= {3, 4, 99}
            if name == "simhash_near_dedup":
                assert ids.count(None) == 1 and ids.count(0) == 1 and 1 not in ids and 7 not in ids and 6 in ids
                assert len({3, 4, 5, 99} & set(ids)) == 1 and next(r for r in got if r.doc_id == 6).text == LONG
            if name == "mixing":
                assert ids.count(3) == 1 and ids.count(4) == 1
            if name == "sentencepiece":
                assert len(got) == table.count() and all(r.round_trip for r in got if r.ids is not None)
                assert {r.doc_id for r in got if r.ids is None} == {3, 99} and {r.n_pieces for r in got if r.doc_id == 4} == {0}
