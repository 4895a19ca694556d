"""Line dedup by a log-template tree.

A line descends a tree of fixed depth: first by its number of tokens, then by its leading tokens, where tokens with a
digit count as variable. Templates generalise lines in two grades: every token with a digit is a field; and, in a leaf,
so is one run of up to three other tokens, a quarter of the line at most. A line stands for as many templates of the second
grade as there are places for that run, so what else a leaf holds, and how much, changes nothing. To spare work, only
lines that share about half of their tokens from the start or from the end with enough others are generalised; of two lines
of one template the longer of these ends is always equal. Lines of less than four tokens have the first grade only.
Templates that recur across documents are boilerplate, and their lines are dropped.

To recur, a template must stand in at least `least` different texts that have something of their own. Copies of documents
share nearly all of their parts and prove nothing about a line: texts are cut into pieces at punctuation and every 64
characters, and a text is a copy if over five sixths of its different pieces stand in `least` documents or more. (Of two
texts at the near-duplicate likeness of 0.8 a ninth is different.) Dropping copies is a matter for deduplication of
documents. More copies of a text never make a template less frequent.

All of it is DataFrame expressions. Groups are counted with partial aggregation, so a template that a third of all
documents hold costs a row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, table
from .names import unused

LEAST_DOCUMENTS, LEAST_TOKENS, DEPTH = 5, 4, 2
#: The longest run of tokens that is a field, the tokens of a line per token of its field, and the number of pieces per own one
#: from which a text is a copy.
RUN, SHARE, OWN = 3, 4, 6
#: White space within a line, the piece of a text (what is shorter isn't counted), and a token with a digit.
BLANK, PIECE, FIELD = r"[\x09\x0B-\x0D]", r"[^.,;:!?\x0A]{8,64}", r"[^\x20\x0A]*[0-9][^\x20\x0A]*"


def text_lines() -> Column:
    return F.split(F.coalesce(F.col("text"), F.lit("")), "\n")


def plain_lines() -> Column:
    """The lines with spaces as their only white space."""
    plain = F.when(F.col("text").rlike(BLANK), F.regexp_replace("text", BLANK, " ")).otherwise(F.coalesce("text", F.lit("")))
    return F.split(plain, "\n")


def masked(line: Column) -> Column:
    """A plain line without outer spaces, tokens with a digit generalised. Tokens are what one space each parts."""
    trimmed = F.trim(line)
    return F.when(line.rlike("[0-9]"), F.regexp_replace(trimmed, rf"(?<![^\x20]){FIELD}", "<*>")).otherwise(trimmed)


def parse_lines(docs: DataFrame, depth: int = DEPTH, least_tokens: int = LEAST_TOKENS) -> DataFrame:
    """A row per line with a letter outside its fields: doc_id and _text (a hash of the text) of its document, _at (its
    number), _template and _leaf (null for lines of too few tokens)."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("_text"), F.posexplode(F.transform(plain_lines(), masked)).alias("_at", "_line"))
    line = F.col("_line")
    tokens = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1
    leaf = F.when(tokens >= least_tokens, F.xxhash64(tokens, F.substring_index(line, " ", depth)))
    return rows.filter(line.rlike(r"\p{L}")).select("doc_id", "_text", "_at", leaf.alias("_leaf"), F.xxhash64(line).alias("_template"))


def copied_texts(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """_text of the texts of which less than a sixth is their own; texts too short for a piece aren't among them."""
    each = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(PIECE), F.lit(0)), lambda p: F.xxhash64(p)))
    cut = docs.select(F.xxhash64("text").alias("_text"), F.monotonically_increasing_id().alias("_row"), each.alias("_p"))
    pieces = materialize(cut.select("_text", "_row", F.size("_p").alias("_whole"), F.explode("_p").alias("_piece")), "pieces")
    common = materialize(pieces.groupBy("_piece").agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).select("_piece"), "common")
    # A merge join at every size: the common pieces grow with the corpus.
    shared = pieces.hint("merge").join(common, "_piece", "left_semi").groupBy("_text", "_row", "_whole").agg(F.count("*").alias("_shared"))
    return shared.filter(OWN * (F.col("_whole") - F.col("_shared")) < F.col("_whole")).select("_text").distinct()


def recurring(lines: DataFrame, template: str, copied: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """The templates that occur in `least` or more texts that aren't copied."""
    seen = lines.select(template, "_text").distinct().join(copied, "_text", "left_anti")
    return seen.groupBy(template).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).select(template)


def crowded(docs: DataFrame, lines: DataFrame, copied: DataFrame, least: int) -> DataFrame:
    """The lines of leaves that hold `least` lines or more of texts that aren't copied, with whether the text is its _own, and
    the _tokens: a hash of each token and its place."""
    rest = lines.filter("_leaf is not null").join(copied.withColumn("_copied", F.lit(True)), "_text", "left")
    sizes = rest.filter("_copied is null").groupBy("_leaf").agg(F.count("*").alias("_size")).filter(F.col("_size") >= least).select("_leaf")
    wanted = rest.join(sizes, "_leaf").groupBy(F.col("doc_id").alias("_id"), F.col("_text").alias("_hash")).agg(F.first(F.col("_copied").isNull()).alias("_own"), F.collect_set(F.struct("_at", "_leaf")).alias("_l"))
    # Merge joins of texts at every size: what is wanted grows with the corpus, and so would a broadcast of it.
    joined = docs.select("doc_id", "text").hint("merge").join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash")))
    token = lambda w, i: F.xxhash64(i, w)
    told = lambda ls: F.transform("_l", lambda at: F.struct(at["_at"].alias("_at"), at["_leaf"].alias("_leaf"), F.transform(F.split(masked(F.get(ls, at["_at"])), " "), token).alias("_tokens")))
    # The lines are bound by a lambda, so that a text is split once and not once for each of its lines.
    each = F.element_at(F.transform(F.array(plain_lines()), told), 1)
    return joined.select("doc_id", F.col("_hash").alias("_text"), "_own", F.explode(each).alias("_l")).select("doc_id", "_text", "_own", "_l.*")


def together(tokens: Column) -> Column:
    """One hash of hashed tokens, from which the hash of any of them can be taken out again."""
    return F.aggregate(tokens, F.lit(0).cast("long"), lambda a, t: a.bitwiseXOR(t))


def generalised(lines: DataFrame, least: int) -> DataFrame:
    """The lines that share an end with lines of `least` own texts, a row for each _group (template) that they may be of.
    Those with a common start have their field behind it, those with a common end before it; either set holds a template's
    lines together."""
    n = F.size("_tokens")
    widest = F.least(F.lit(RUN), F.floor(n / SHARE)).cast("int")
    end = F.ceil((n - widest) / 2).cast("int")
    parts = (F.slice("_tokens", F.lit(1), end), F.slice("_tokens", n - end + 1, end))
    ends = F.array(*[F.struct(F.xxhash64("_leaf", F.lit(k), together(part)).alias("_end"), F.lit(k == 0).alias("_start")) for k, part in enumerate(parts)])
    both = lines.withColumn("_e", F.explode(ends)).select(*lines.columns, "_e.*")
    shared = both.filter("_own").select("_end", "_text").distinct().groupBy("_end").agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).select("_end")
    met = both.join(shared, "_end", "left_semi").withColumn("_whole", together(F.col("_tokens")))
    without = lambda w, at: F.xxhash64("_leaf", w, at, F.col("_whole").bitwiseXOR(together(F.slice("_tokens", at + 1, w))))
    first = F.when(F.col("_start"), F.greatest(F.lit(DEPTH), end)).otherwise(DEPTH)
    last = lambda w: F.when(F.col("_start"), n - w).otherwise(F.least(end - 1, n - end - w))
    places = lambda w: F.when(last(w) >= first, F.sequence(first, last(w))).otherwise(F.array().cast("array<int>"))
    groups = F.flatten(F.transform(F.sequence(F.lit(1), widest), lambda w: F.transform(places(w), lambda at: without(w, at))))
    return met.select("doc_id", "_text", "_own", "_at", F.explode(groups).alias("_group"))


def boilerplate(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """doc_id, _text and _drop: the numbers of the lines to drop, for each document that has any.

    Lines whose own template recurs go first; the leaves' templates are found among the others.
    """
    copied = materialize(copied_texts(docs, least), "copied")
    lines = materialize(parse_lines(docs), "lines")
    known = materialize(recurring(lines, "_template", copied, least), "templates")
    same = lines.join(known, "_template", "left_semi")
    alike = generalised(materialize(crowded(docs, lines.join(known, "_template", "left_anti"), copied, least), "leaves"), least)
    alike = materialize(alike, "alike")
    seen = alike.filter("_own").select("_group", "_text").distinct().groupBy("_group").agg(F.count("*").alias("_n"))
    near = alike.join(materialize(seen.filter(F.col("_n") >= least).select("_group"), "groups"), "_group", "left_semi")
    both = same.select("doc_id", "_text", "_at").union(near.select("doc_id", "_text", "_at"))
    return both.groupBy("doc_id", "_text").agg(F.collect_set("_at").alias("_drop"))


def judge(docs: DataFrame, least: int) -> tuple[DataFrame, str, str, str]:
    """docs with three columns more, and their names: the shortened text, the number of lines, that of dropped ones."""
    kept, lines, removed, doc, text, drop = unused(docs, "_kept", "_lines", "_removed", "_id", "_hash", "_drop")
    found = boilerplate(docs.select("doc_id", "text"), least).withColumnsRenamed({"doc_id": doc, "_text": text, "_drop": drop})
    joined = docs.hint("merge").join(found, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(text)), "left")
    gone = F.coalesce(F.col(drop), F.array().cast("array<int>"))
    rest = F.transform(F.array(text_lines()), lambda ls: F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), drop), lambda i: F.get(ls, i)))
    shorter = F.when(F.size(gone) == 0, F.col("text")).otherwise(F.array_join(F.element_at(rest, 1), "\n"))
    numbers = {lines: F.size(text_lines()).cast("long"), removed: F.size(gone).cast("long")}
    return joined.withColumns({kept: shorter} | numbers).drop(doc, text, drop), kept, lines, removed


def drop_boilerplate(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """docs with `kept` (the text without boilerplate lines), `n_lines` and `n_removed`; columns of docs with these names
    are replaced.

    Every row stays. A null text counts as empty (one empty line) and stays null; blank lines and lines without a letter
    stay. Rows with the same id and text count as one document and lose the same lines; null ids are ids like any other.
    An empty table gives no rows.
    """
    judged, *names = judge(docs, least)
    return judged.withColumns(dict(zip(("kept", "n_lines", "n_removed"), map(F.col, names)))).drop(*names)


def without_boilerplate(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """docs with the shortened text and its n_chars."""
    judged, kept, *_ = judge(docs, least)
    shorter = {"text": F.col(kept), "n_chars": F.coalesce(F.length(kept), F.lit(0)).cast("long")}
    return judged.withColumns(shorter).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce(F.col("kept"), F.lit("")), 256).alias("kept_sha256"))
