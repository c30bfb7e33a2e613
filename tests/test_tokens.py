"""Rules on tokens in Python say what the column functions say, and texts are not taken apart over a shuffle."""

import pytest

from palimpsest import registry
from palimpsest.functions import tokens as K
from palimpsest.operators import extraction as X
from palimpsest.operators import spans as N

ODD = [
    "MDCII", "mdc1", "MD-C", "an1", "anno", "1an", "iii", "iiit", "İiii", "ııı", "ſſſ", "KKK", "aaa", "x́x́x́", "strbcdfgh", "Strbcdf", "qxz", "xq", "12", "a1", "l'an", "[…]", "?", "a?", "…", "--.,", "§§§", "a§§", "𝔄𝔅𝔠𝔡", "ΑΣ", "zz",
    "bcdfghjklmnpqrst", "aeiou", "éèê", "Œuvre", "ab-c", "AB-cd", "ab-", "-", "a", "b", "'", "naïvebcdfg", "Ⅷ", "٣", "ªº", "ﬁn", "vvv", "IIIIII", "kkk1", "MCM1", "zxzxzx", "jjjj", "qqaq", "éxzé", "abbbx", "ßß", "ÿy",
]


def shuffles(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_suspicious_as_the_column_says(spark):
    from palimpsest.plans.rules import suspicious

    got = spark.createDataFrame([(t,) for t in ODD], "t string").select("t", suspicious(K.T.F.col("t")).alias("s")).collect()
    assert [(r["t"], r["s"]) for r in got] == [(t, K.suspicious(t, t.lower(), K.letters(t), K.vowel_ratio(t.lower()))) for t in ODD]


@pytest.mark.parametrize("text, marked", [
    ("", ("", 0)), ("all is well here", ("all is well here", 0)), ("strngths  ab\n x  zxcvb yy ", ("strngths? ab\n x  zxcvb yy ", 1)),
    ("strngths? zxcvb", ("strngths? zxcvb", 0)), ("a §§§ \n\n ", ("a §§§ \n\n [?]", 1)), (" ".join(["zxcvb"] * 40), (" ".join(["zxcvb?"] * 3 + ["zxcvb"] * 37), 3)),
])
def test_forced_marks(text, marked):
    assert K.forced_marks(text) == marked


def test_forced_markers_shuffle_no_tokens(spark, sf):
    assert shuffles(registry.queries()["T66_forced_markers"](spark, sf)) == 0


TEXTS = [
    "", "Jean de Berry vint.\nEt Marie Anne parla 😀 Guillaume de Machaut.\nIX Louis", "A B C D E F G Des De Du X", "Le livre\n de Paris le 12 MCCXL an de grâce, l'an mil\ndeux ÉVESQUE prince_ prince", "le roi Artus vint en  Lausanne_ de la Tour",
    "Dame ſire Guenievre, mon Seigneur del Payſ ſaint ĀĪŌŪĒ", "L’an  mil cinq\n1234\xa0M\u2028MDCII an1234 1999é é1999 lan\u2028mil", "\u2029 l’ amour fin \t\nroi Duc évesque x", "de d'Avignon De\x1fla d’ En enfant AU Chastelx aux  ab des\n\nParis",
]


def test_mentions_as_the_extractors_find(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for frame, function in ((X.person_mentions, N.persons), (X.anchor_mentions, N.anchors), (X.high_recall_mentions, N.high_recall)):
        got = sorted(tuple(r) for r in frame(docs).collect())
        assert got == sorted((i, *m) for i, text in enumerate(TEXTS) for m in function(text)), frame


def test_overlaps_go_as_in_the_fold(spark):
    rows = [(1, *m) for m in N.persons(TEXTS[1]) + N.high_recall(TEXTS[1]) + [(0, 4, "Jean", "person", 0.9, "b"), (0, 4, "Jean", "person", 0.9, "a"), (3, 3, "", "x", 1.0, "r")]]
    want = X.without_overlaps(spark.createDataFrame(rows, "doc_id long, " + N.SCHEMA)).collect()
    assert sorted(tuple(r) for r in want) == sorted((1, *m) for m in N.without_overlaps([r[1:] for r in rows]))


def test_salvage_functions_as_the_columns(spark):
    from palimpsest.plans.rules import NAMES, medieval_name

    F, words = K.T.F, [*ODD, *NAMES, "artuz", "lancelott", "percevol", "lac", "bor", "bors", "xqzt", "paris", "chastelx", "a" * 18, "ab" * 10]
    got = spark.createDataFrame([(w,) for w in words], "t string").select("t", K.T.token_quality(F.col("t")).alias("q"), medieval_name(F.col("t")).alias("m")).collect()
    assert [tuple(r) for r in got] == [(w, N.token_quality(w), N.medieval_name(w, tuple(NAMES))) for w in words]


@pytest.mark.parametrize("name", ["M3_salvaged_mentions", "X6_W5_deduplicated_mentions"])
def test_mentions_shuffle_no_tokens(spark, sf, name):
    assert shuffles(registry.queries()[name](spark, sf)) == 0


LINE_TEXTS = ["", " ", "x", "é", "ab\r\n- x y\n\n z -\x85–\u2028a", "b c\x0b d\x1c et\nEt ab Ab\xa0", "a-b- \n ΑΣ σ Σ", "x[…] … a?\n qq zz\n\rk ", "1 ٣ Ⅷ ª", "strbcdfg" * 3, "😀 😀𝔄", *ODD]


def test_signals_as_the_columns_say(spark):
    from palimpsest.plans.text_quality import entropies

    F, T = K.T.F, K.T
    docs = spark.createDataFrame(list(enumerate(LINE_TEXTS)), "doc_id long, text string")
    toks, rows, text = T.tokens("text"), T.lines("text"), F.col("text")
    count = lambda xs, test: F.size(F.filter(xs, test))
    long = lambda w: F.length(w) >= 3
    got = docs.join(entropies(docs), "doc_id", "left").select(
        "doc_id", F.size(toks), count(toks, long), count(toks, lambda w: long(w) & (T.non_wordlike(w) > 0.45)), count(toks, lambda w: w.contains("?") | w.contains("…") | w.contains("[")), F.size(rows), count(rows, T.leading_fragment),
        count(rows, lambda r: T.leading_fragment(r) | T.trailing_break(r)), count(rows, T.trailing_fragment), F.coalesce("entropy", F.lit(0.0)), T.rare_bigram_ratio(text), T.uncertainty_density(text),
    ).collect()
    for r in got:
        assert tuple(r)[1:] == pytest.approx(K.signals(LINE_TEXTS[r["doc_id"]])), repr(LINE_TEXTS[r["doc_id"]])


def test_non_wordlike_as_the_column_says(spark):
    got = spark.createDataFrame([(t,) for t in ODD], "t string").select("t", K.T.non_wordlike(K.T.F.col("t")).alias("s")).collect()
    assert [(r["t"], r["s"]) for r in got] == [(t, K.non_wordlike(t)) for t in ODD]


@pytest.mark.parametrize("a, b, want", [
    ("", "", ("", 0)), ("a  b\n\nc", "a b\n\nc", ("a b\n\nc", 0)), ("zxkq- word", "word", ("????- word", 1)), ("Ab-xq ok", "ok", ("[…] ok", 1)), ("x zxkq\nzxkq", "x\nzxkq", ("x ????\n????", 2)), ("same", "same\nmore", ("same", 0)),
])
def test_marked_passes(a, b, want):
    assert K.marked(a, b) == want


@pytest.mark.parametrize("name", ["P8_proofread_guard", "T45_quality_report", "X2_uncertainty_markers"])
def test_reports_shuffle_no_tokens(spark, sf, name):
    assert shuffles(registry.queries()[name](spark, sf)) == 0


def test_reports_are_made_once(spark, sf, monkeypatch):
    from palimpsest.operators import store

    plans, write = [], store.append_parquet
    monkeypatch.setattr(store, "append_parquet", lambda rows, path: (plans.append(rows._jdf.queryExecution().optimizedPlan().toString()), write(rows, path)))
    assert registry.queries()["S30_insert_quality_report"](spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert sum("MapInArrow" in p for p in plans) == 1


def test_works_are_the_first_that_is_near():
    words = [*ODD, *K.C.COMMON_WORDS, *N.X.SALVAGE_WORKS, "lancelott", "artur", "arthurs", "merlyn", "graa", "graals", "percevol", "xyzzy"]
    near = lambda t, x: t == x or (len(t) >= 5 and N.distance(t, x) <= 0.25 and N.overlap(t, x) >= 0.40)
    for t in map(str.lower, words):
        want = None if len(t) < 4 or t in N.COMMON else next((N.distance(t, x) for x in N.X.SALVAGE_WORKS if near(t, x)), None)
        assert N.work(t) == want
