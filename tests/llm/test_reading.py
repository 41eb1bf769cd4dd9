import numpy as np

from tests.compared import FOLDER
from traceloom.llm import reading as R


def test_held_out_passages():
    import duckdb

    docs = [t for (t,) in duckdb.sql(f"select text from '{FOLDER}/documents.parquet' where text is not null").fetchall()]
    graded = duckdb.sql(f"select band, passage from '{FOLDER}/graded_passages.parquet' order by passage_id").fetchall()
    from collections import Counter

    df = Counter(w for t in docs for w in set(R._words("\n".join(R.prose_lines(t)))))
    familiar = frozenset(w for w, _ in sorted(df.items(), key=lambda x: (-x[1], x[0]))[: R.FAMILIAR])
    x, bands = np.array([R.measure(p, familiar).features for _, p in graded]), [b for b, _ in graded]
    right = 0
    for k in range(5):
        test = np.arange(len(x)) % 5 == k
        model = R.grade(x[~test], [b for b, t in zip(bands, test) if not t])
        right += sum(a == b for a, b in zip(model.bands_of(x[test]), [b for b, t in zip(bands, test) if t]))
    assert right / len(x) >= 0.97


def test_own_prose_only(spark):
    easy = " ".join("The cat sat on the mat. It was a red cat and we saw it." for _ in range(12))
    hard = " ".join("Consequently the interpretation of hermeneutic equivalence, insofar as it presupposes the systemic autocorrelation of the thermodynamic apparatus, substantiates that which the formalism underdetermines." for _ in range(8))
    menu = "Home | News\nThis site stores small files on your device."
    rows = [(i, f"{menu}\n{easy}", 0) for i in range(4)] + [(10 + i, f"{menu}\n{hard}", 0) for i in range(4)]
    rows += [(20, menu, 0), (21, None, 0), (22, "", 0), (23, "Der Hund lief in das Haus und sah den Mann. " * 30, 0), (0, f"{menu}\n{easy}", 0)]
    graded = [(1, "basic", easy[:300]), (2, "basic", easy[60:380]), (3, "advanced", hard[:420]), (4, "advanced", hard[:800]), (5, None, "x"), (6, "basic", None)]
    got = R.reading_levels(spark.createDataFrame(rows, "doc_id long, text string, words int"), spark.createDataFrame(graded, "passage_id long, band string, passage string")).collect()
    assert sorted((r["doc_id"], r["band"]) for r in got) == sorted([(0, "basic")] * 2 + [(i, "basic") for i in (1, 2, 3)] + [(10 + i, "advanced") for i in range(4)])
    assert {r["words"] for r in got if r["doc_id"] < 10} == {180}


def test_empty(spark):
    docs, graded = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "passage_id long, band string, passage string")
    assert R.reading_levels(docs, graded).count() == 0


def test_joined_lines():
    assert R.prose_lines("Heading\nThe quick brown fox was here and jum-\nped over it. Yes.\nmenu | item one two three four.\n\nA short end.") == ["The quick brown fox was here and jumped over it. Yes."]


def test_mirrored_article_stays_and_long_furniture_goes(spark):
    rng = np.random.default_rng(4)
    nouns = ["cat", "dog", "boat", "tree", "house", "river", "lamp", "bread", "stone", "horse", "cloud", "field"]
    prose = lambda k: "\n".join(f"The {a} was on the {b} and the {c} was in the {d} number {'abcdefghijklmnopqrstuvwxyz'[i]}{'x' * k}." for i, (a, b, c, d) in enumerate(rng.choice(nouns, (12, 4))))
    long = "This site and its partners store small files on your device and read them again later. " * 4 + "You agree to it."
    menus = ["Sign in now to read more of it.", "All rights are reserved by us.", "Write to us if you like it."]
    mirrored = prose(0)
    rows = [(i, f"{menus[i % 3]}\n{mirrored}\n{long if i % 2 else menus[(i + 1) % 3]}") for i in range(12)]
    rows += [(100 + i, f"{menus[i % 3]}\n{prose(i + 1)}\n{long}") for i in range(24)]
    got = R.furniture(spark.createDataFrame(rows, "doc_id long, text string"), "text")
    assert got == {R.line_key(x) for x in [*menus, long]}
    graded = [(1, "basic", mirrored), (2, "advanced", long)]
    levels = R.reading_levels(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(graded, "passage_id long, band string, passage string")).collect()
    assert {r["doc_id"]: r["words"] for r in levels} == {i: 12 * 15 for i, _ in rows}
