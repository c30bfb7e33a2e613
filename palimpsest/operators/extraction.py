"""Chunks and mentions with code-point offsets, as DataFrame operations only."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import constants as C
from palimpsest.functions import text as T

# Token and span patterns, particles, trigger words, prefixes, confidences.
TOKEN = r"[A-Za-zÀ-ÖØ-öø-ÿ][A-Za-zÀ-ÖØ-öø-ÿ'’\-]*"
ROMAN = "(?i)^[IVXLCDM]+$"
PARTICLES = ["de", "d'", "d’", "du", "des"]
TRIGGERS = {
    "person": sorted(set("roi rois roy dame dames damoisele sire sires monseigneur evesque euesque eusque prince princesse conte comte duc duchesse chevalier chevaliers frere pere pape abbé dominus domini episcopus rex regis papa".split())),
    "place": "chastel cité ville forest terre royaume pays mont".split(),
}
PREFIXES = "messire monseigneur monseignor mon ma li le la del des ser fra frere pere mere saint sainte san santa".split()
RECALL_TOKEN = "[A-Za-zÀ-ÿĀ-žſ]+"
EDGE = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
DATE_PATTERNS = (
    r"(?:l['’]an|lan|an de grace)" + EDGE[1] + r"(?:\s+[A-Za-z0-9]+){0,4}",
    r"(?:mil|mille)" + EDGE[1] + r"(?:\s+[A-Za-z0-9]+){0,4}",
    r"(?-i:1[0-9]{3})" + EDGE[1],
    r"(?-i:M{1,4}[CDLXVI]{2,})" + EDGE[1],
)
DATE_FORMULA = "(?i)" + EDGE[0] + r"(?:l['’]an|lan|an\s+de\s+grace)\s+(?:mil|mille)" + EDGE[1]
NUMBER = EDGE[0] + "[0-9]{3,4}" + EDGE[1]
ROMAN_YEAR = EDGE[0] + "M{1,4}[CDLXVI]{2,}" + EDGE[1]
NAMES_MOST, REACH = 5, 6
#: Between two tokens of one name: no line break.
JOINED = "^[ \t\xa0\x1f,.;:()\\-–—]*\\z"

MENTION = ["doc_id", "start_offset", "end_offset", "surface", "ent_type", "confidence", "method"]


def occurrences(docs: DataFrame, pattern: str, text: str = "text") -> DataFrame:
    """(doc_id, pos, gap, surface, start_offset, end_offset): every match of a Java pattern, left to right, with the text before it.

    Offsets come from running sums of the lengths of gaps and matches; a document
    is shuffled once, on its id, before it is exploded.
    """
    both = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)).alias("surface"))
    rows = docs.repartition("doc_id").select("doc_id", F.posexplode(both).alias("pos", "m")).select("doc_id", "pos", "m.gap", "m.surface").where("surface IS NOT NULL")
    end = F.sum(F.length("gap") + F.length("surface")).over(Window.partitionBy("doc_id").orderBy("pos"))
    return rows.withColumn("end_offset", end.cast("int")).withColumn("start_offset", (F.col("end_offset") - F.length("surface")).cast("int"))


def _mention(rows: DataFrame, kind, confidence, method) -> DataFrame:
    column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return rows.select("doc_id", "start_offset", "end_offset", "surface", column(kind).alias("ent_type"), column(confidence).cast("double").alias("confidence"), column(method).alias("method"))


def sequence_pattern(joint: str = "-", name: str = "N", particle: str = "[PB]", first: str = "[NB]") -> str:
    """A regular expression for names in a row, over two signs a token (how it joins the one before, what it is).

    A first name, then one to four more, particles between them, all within six
    tokens; the most names that fit are tried first.
    """
    tries = []
    for names in range(NAMES_MOST - 1, 0, -1):
        for between in product(range(REACH - names + 1), repeat=names):
            if sum(between) + names <= REACH:
                tries.append("".join(f"(?:{joint}{particle}){{{n}}}{joint}{name}" if n else joint + name for n in between))
    return first + "(?:" + "|".join(tries) + ")"


def person_mentions(docs: DataFrame) -> DataFrame:
    """Two to five capitalised names in a row on one line, particles between them allowed.

    Each token becomes two signs (joined or not; name, particle, both or other),
    and the names in a row are matches of one pattern on the signs of a text.
    """
    low = F.lower("surface")
    name = F.col("surface").rlike(r"^\p{Lu}") & ~F.col("surface").rlike(ROMAN)
    kind = F.when(name & low.isin(PARTICLES), "B").when(name, "N").when(low.isin(PARTICLES), "P").otherwise("x")
    tokens = occurrences(docs, TOKEN).select("doc_id", "pos", "start_offset", "end_offset", F.concat(F.when(F.col("gap").rlike(JOINED), "-").otherwise("|"), kind).alias("sign"))
    by_doc = tokens.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "sign", "start_offset", "end_offset"))).alias("t"))
    signs = by_doc.select("doc_id", "t", F.array_join(F.col("t.sign"), "").alias("text")).where(F.col("text").rlike("[NB]-"))
    runs = occurrences(signs.select("doc_id", "text"), sequence_pattern()).join(signs, "doc_id")
    # A match begins on the second sign of its first token and ends behind its last one.
    first, last = F.expr("t[(start_offset - 1) div 2]"), F.expr("t[(end_offset - 2) div 2]")
    count = F.length(F.regexp_replace(F.col("surface"), "[^N]", "")) + F.when(F.col("surface").startswith("B"), 1).otherwise(0)
    linked = F.substring(F.col("text"), F.col("start_offset") + 2, F.lit(2 * REACH)).rlike("^(?:-N)*-[PB]")
    runs = runs.select("doc_id", first["start_offset"].alias("start_offset"), last["end_offset"].alias("end_offset"), (0.65 + F.least(F.lit(0.15), 0.05 * (count - 2))).alias("c"), linked.alias("linked"))
    runs = runs.withColumn("confidence", F.round(F.when(F.col("linked"), F.least(F.lit(0.85), F.col("c") + 0.05)).otherwise(F.col("c")), 4))
    shown = runs.join(docs.select("doc_id", "text"), "doc_id").withColumn("surface", F.expr("substring(text, start_offset + 1, end_offset - start_offset)"))
    return _mention(shown, "person", F.col("confidence"), "rule:proper_name_sequence")


def word_anchors(docs: DataFrame) -> DataFrame:
    """Known places and titles, as whole words."""
    words = occurrences(docs, r"[\p{L}\p{N}_]+")
    low = F.lower("surface")
    place = low.isin(C.PLACE_ANCHORS)
    kept = words.where(place | low.isin(C.TITLE_ANCHORS))
    return _mention(kept, F.when(place, "place").otherwise("title"), F.when(place, 0.84).otherwise(0.64), F.when(place, "rule:toponym_anchor").otherwise("rule:title_anchor"))


def has_date_anchor(span: Column) -> Column:
    """A date formula, a number of three or four digits, a Roman year, or a month or date word."""
    words = F.regexp_extract_all(F.lower(span), F.lit("([A-Za-zÀ-ÿ'’]+)"), F.lit(1))
    return span.rlike(DATE_FORMULA) | span.rlike(NUMBER) | span.rlike(ROMAN_YEAR) | F.arrays_overlap(words, F.array(*[F.lit(w) for w in [*C.DATE_ANCHORS, *C.MONTHS]]))


def date_mentions(docs: DataFrame) -> DataFrame:
    """Spans of the date patterns that hold a date anchor; over a line break in the first and the last line, or as a formula."""
    found = None
    for pattern in DATE_PATTERNS:
        rows = occurrences(docs, f"(?i){EDGE[0]}{pattern}")
        found = rows if found is None else found.unionByName(rows)
    span, parts = F.col("surface"), F.split("surface", "\n")
    whole = (F.size(parts) == 1) | span.rlike(DATE_FORMULA) | (has_date_anchor(parts[0]) & has_date_anchor(F.element_at(parts, -1)))
    return _mention(found.where(has_date_anchor(span) & whole), "date", 0.72, "rule:date_pattern")


def first_line_mentions(docs: DataFrame) -> DataFrame:
    """A first line of at most 80 characters and two words or more that starts with an article."""
    first = F.try_element_at(F.filter(F.transform(F.split("text", "\n"), T.strip), lambda s: s != ""), F.lit(1))
    rows = docs.select("doc_id", "text", first.alias("surface"))
    rows = rows.where((F.length("surface") <= 80) & F.lower("surface").rlike("^(la |le |l'|l’)") & (F.size(T.tokens("surface")) >= 2))
    rows = rows.withColumn("start_offset", F.expr("cast(locate(surface, text) - 1 as int)")).withColumn("end_offset", F.expr("cast(start_offset + length(surface) as int)"))
    return _mention(rows, "work", 0.56, "rule:first_line_title_heuristic")


def anchor_mentions(docs: DataFrame) -> DataFrame:
    return word_anchors(docs).unionByName(date_mentions(docs)).unionByName(first_line_mentions(docs))


def high_recall_mentions(docs: DataFrame) -> DataFrame:
    """Tokens after a trigger (two, if a prefix or a longer token follows at once), longer capitalised tokens, and prefix plus token."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    ahead = lambda c, n: F.lead(c, n).over(w)
    rows = occurrences(docs, RECALL_TOKEN).withColumns({"next": ahead("surface", 1), "next_start": ahead("start_offset", 1), "next_end": ahead("end_offset", 1), "next_gap": ahead("gap", 1), "third": ahead("surface", 2), "third_gap": ahead("gap", 2), "third_end": ahead("end_offset", 2)})
    low = F.lower("surface")
    kind = F.when(low.isin(TRIGGERS["person"]), "person").when(low.isin(TRIGGERS["place"]), "place")
    more = F.coalesce((F.lower("third").isin(PREFIXES) | (F.length("third") >= 4)) & (F.length("third_gap") <= 2), F.lit(False))
    triggered = rows.where(kind.isNotNull() & (F.length("next") >= 3)).select("doc_id", F.col("next_start").alias("start_offset"), F.when(more, F.col("third_end")).otherwise(F.col("next_end")).alias("end_offset"), F.when(more, F.concat("next", "third_gap", "third")).otherwise(F.col("next")).alias("surface"), kind.alias("kind"))
    prefixed = rows.where(low.isin(PREFIXES) & (F.length("next") >= 4)).select("doc_id", "start_offset", F.col("next_end").alias("end_offset"), F.concat("surface", "next_gap", "next").alias("surface"))
    capital = rows.where((F.length("surface") >= 5) & F.col("surface").rlike(r"^\p{Lu}"))
    return (
        _mention(triggered, F.col("kind"), 0.35, "high_recall:trigger")
        .unionByName(_mention(capital, "person", 0.25, "high_recall:capitalized"))
        .unionByName(_mention(prefixed, "person", 0.30, "high_recall:name_prefix"))
    )


# Salvage words and thresholds.
SALVAGE_TRIGGERS = "roi roy roya evesque évesque euesque saint sainz pape duc conte dame sire".split()
SALVAGE_WORKS = "lancelot arthur guenievre tristan perceval graal merlin galahad".split()
SALVAGE_STOPWORDS = (
    "et de la le les des du en a au aux que qui ne pas par pour sur son ses sa ce est fut sont une uns si il li lor mais car con com tout molt bien fait dit "
    "del d' d’ mes ot ont vint fist dist estoit avoit ala alerent vont font firent puis lors tant moult aussi donc dont"
).split()
SALVAGE_TOKEN = "[A-Za-zÀ-ÖØ-öø-ÿĀ-žſƀ-ɏ]+"
PLACE_PREPOSITION = "(?:en|au|aux|de\\s+la|de\\s+l['’]|de|du|des|del|d['’])\\s+"
EDITORIAL = "lacune lacuna lacunae illegible gap missing illisible effacé rature trou déchirure dechirure".split()
WEAK_PLACES = "enfant enfans enfants vilanie vilenie villanie amor amour courtoisie felonie honte honor honneur merci paor peor peur proece proesce chevalerie".split()
PARTS = 4


def without_overlaps(mentions: DataFrame) -> DataFrame:
    """Best confidence of each span and type; then, from the surest and longest, those that overlap no kept one of their type."""
    best = mentions.where("end_offset > start_offset AND start_offset >= 0").groupBy("doc_id", "ent_type", "start_offset", "end_offset").agg(F.max_by(F.struct("surface", "method"), F.struct("confidence", "method")).alias("m"), F.max("confidence").alias("confidence"))
    order = F.struct((-F.col("confidence")).alias("c"), (F.col("start_offset") - F.col("end_offset")).alias("l"), F.col("start_offset").alias("s"), F.col("end_offset").alias("e"), F.col("m.surface").alias("surface"), F.col("m.method").alias("method"))
    ranked = best.groupBy("doc_id", "ent_type").agg(F.array_sort(F.collect_list(order)).alias("all"))
    free = lambda kept, x: ~F.exists(kept, lambda k: (x["s"] < k["e"]) & (x["e"] > k["s"]))
    kept = F.aggregate("all", F.slice("all", 1, 0), lambda kept, x: F.when(free(kept, x), F.concat(kept, F.array(x))).otherwise(kept))
    rows = ranked.select("doc_id", "ent_type", F.explode(kept).alias("k"))
    return rows.select("doc_id", F.col("k.s").alias("start_offset"), F.col("k.e").alias("end_offset"), "k.surface", "ent_type", (-F.col("k.c")).alias("confidence"), "k.method")


def line_chunks(docs: DataFrame) -> DataFrame:
    """One chunk for each line of two or more characters that is no stop word, with offsets of the raw line; else the whole text."""
    parts = docs.select("doc_id", "text", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    end = F.sum(F.length("line") + 1).over(Window.partitionBy("doc_id").orderBy("pos")) - 1
    bare = T.strip("line")
    rows = parts.withColumn("end_offset", end.cast("int")).withColumn("start_offset", (F.col("end_offset") - F.length("line")).cast("int"))
    kept = rows.where((F.length(bare) >= 2) & ~F.lower(bare).isin(*C.CHUNK_STOPWORDS))
    idx = (F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1).cast("int")
    chunks = kept.select("doc_id", idx.alias("idx"), "start_offset", "end_offset", F.col("line").alias("text"))
    whole = docs.where(F.length(T.strip("text")) > 0).join(kept.select("doc_id").distinct(), "doc_id", "left_anti")
    return chunks.unionByName(whole.select("doc_id", F.lit(0).alias("idx"), F.lit(0).alias("start_offset"), F.length("text").alias("end_offset"), "text"))
