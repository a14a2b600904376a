"""Line deduplication by a log-template tree, in DataFrame functions only.

Every line is parsed to a fixed depth: number of tokens, then its leading tokens, with fields that hold a digit masked.
That path is a leaf. Within the leaves that several texts reach, tokens that recur at their place stay and all others
become the wildcard; what is left is the line's template. Lines whose template recurs across enough different texts,
with enough fixed tokens, are dropped, and so are lines that two different texts have as they stand. Lines are first counted by hashes alone; only lines of recurring leaves move. The
small sides (recurring lines, leaves, templates) are counted and broadcast up to a bound, beyond which the joins shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import need
from siltstone.session import dealt, settle, small, table

WILD = "<*>"
#: Leading tokens of the tree's path; different texts that make a template recur; share of fixed tokens of a template.
DEPTH, TEXTS, FIXED = 3, 5, 0.6
#: Different texts that make a line recur as it stands, all tokens fixed.
VERBATIM = 2
#: Lines of fewer tokens are no templates. Those of fewer characters too say little: more texts must have them as they stand.
TOKENS, CHARS, SHORT = 4, 16, 16


def tokens_of(line: str) -> Column:
    """Tokens of a masked line, split at blanks."""
    return F.filter(F.split(F.col(line), " "), lambda t: t != "")


def masked(line: Column) -> Column:
    """A line with the tokens that hold a digit masked. The look-behind starts matches at tokens only, so that a very long token is read once."""
    return F.when(F.regexp_like(line, F.lit("[0-9]")), F.regexp_replace(line, "(?<![^ ])[^ 0-9]*+[0-9][^ ]*", WILD)).otherwise(line)


def lines_of(docs: DataFrame, id_col: str, text: str, depth: int, tokens: int, chars: int) -> DataFrame:
    """_id, _doc (hash of the text), _at (number of the line, from 0), _flat (blanks single), _same (its hash), _short, _leaf (0 below `tokens`).

    Blank lines give no row. Lines without white space to replace skip the pattern, only the leading tokens are masked,
    and no line is cut into all its tokens.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    split = docs.select(F.col(id_col).alias("_id"), F.xxhash64(whole).alias("_doc"), F.posexplode(F.split(whole, "\n", -1)).alias("_at", "_raw")).where(F.regexp_like("_raw", F.lit(r"\S")))
    odd = F.regexp_like("_raw", F.lit(r"[\t\r\f\x0B]")) | F.contains(F.col("_raw"), F.lit("  "))
    flat = split.select("_id", "_doc", "_at", F.trim(F.when(odd, F.regexp_replace("_raw", r"\s+", " ")).otherwise(F.col("_raw"))).alias("_flat"))
    size = F.length("_flat") - F.length(F.replace(F.col("_flat"), F.lit(" "), F.lit(""))) + 1
    sized = flat.select("*", size.alias("_size"), F.xxhash64(F.lit("="), "_flat").alias("_same"))
    short = (F.col("_size") < tokens) & (F.length("_flat") < chars)
    leaf = F.when(F.col("_size") >= tokens, F.xxhash64("_size", masked(F.substring_index("_flat", " ", depth)))).otherwise(F.lit(0).cast("long"))  # never null, else a join would ask for that first and parse twice
    return sized.select("_id", "_doc", "_at", "_flat", "_same", short.alias("_short"), leaf.alias("_leaf"))


def recurring_lines(docs: DataFrame, id_col: str, text: str, depth: int, texts: int, fixed: float, verbatim: int, tokens: int, chars: int, short: int) -> DataFrame:
    """_id, _doc, _lines: the numbers of the lines that recur as they stand, or whose template recurs."""
    lines = lines_of(docs, id_col, text, depth, tokens, chars)
    hashes = settle(lines.select("_id", "_doc", "_at", "_same", "_short", "_leaf"))  # no text: lines are parsed once more only for recurring leaves
    equal = settle(hashes.select("_same", "_short", "_doc").distinct().groupBy("_same", "_short").count().where(F.col("count") >= F.when(F.col("_short"), short).otherwise(verbatim)).select(F.col("_same").alias("_s")))
    same = hashes.join(small(equal), F.col("_same") == F.col("_s"), "left_semi").select("_id", "_doc", "_at")
    leaves = settle(hashes.where(F.col("_leaf") != 0).select("_leaf", "_doc").distinct().groupBy("_leaf").count().where(F.col("count") >= texts).select(F.col("_leaf").alias("_l")))
    inside = lines.join(small(leaves), F.col("_leaf") == F.col("_l"), "left_semi")
    inside = settle(inside.select("_id", "_doc", "_at", "_leaf", masked(F.col("_flat")).alias("_line")))
    forms = settle(inside.select("_leaf", "_line", "_doc").distinct().groupBy("_leaf", "_line").agg(F.count("*").alias("_n")))  # different lines, with their texts
    form = F.xxhash64("_leaf", "_line")
    rows = forms.select("_leaf", "_n", form.alias("_form"), tokens_of("_line").alias("_words")).select("_leaf", "_n", "_form", F.size("_words").alias("_size"), F.posexplode("_words").alias("_p", "_t"))
    places = rows.groupBy("_leaf", "_p", "_t").agg(F.sum("_n").alias("_n")).where(F.col("_n") >= texts)
    kept = places.select(F.col("_leaf").alias("_kl"), F.col("_p").alias("_kp"), F.col("_t").alias("_kt"))
    marked = rows.join(kept, (F.col("_leaf") == F.col("_kl")) & (F.col("_p") == F.col("_kp")) & (F.col("_t") == F.col("_kt")) & (F.col("_t") != WILD))
    template = F.array_sort(F.collect_list(F.struct("_p", "_t")))
    templates = marked.groupBy("_leaf", "_form", "_size").agg(template.alias("_parts")).where(F.size("_parts") >= F.col("_size") * fixed)
    templates = settle(templates.select(F.col("_form").alias("_f"), F.xxhash64("_leaf", "_parts").alias("_template")))
    seen = settle(inside.select("_id", "_doc", "_at", form.alias("_form")).join(small(templates), F.col("_form") == F.col("_f")).select("_id", "_doc", "_at", "_template"))
    often = settle(seen.select("_template", "_doc").distinct().groupBy("_template").count().where(F.col("count") >= texts).select(F.col("_template").alias("_often")))
    drop = seen.join(small(often), F.col("_template") == F.col("_often"), "left_semi").select("_id", "_doc", "_at").unionAll(same)
    return drop.groupBy("_id", "_doc").agg(F.collect_set("_at").alias("_lines"))


def drop_template_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", *, depth: int = DEPTH, texts: int = TEXTS, fixed: float = FIXED, verbatim: int = VERBATIM, tokens: int = TOKENS, chars: int = CHARS, short: int = SHORT) -> DataFrame:
    """Each row of docs as id, kept_text, n_lines, n_dropped.

    Lines end at \\n. Copies of a whole text count once, so that a text's own copies do not make its lines recur. Null
    texts count as empty, with one empty line. Lines of fewer than `tokens` tokens are no templates, and
    those of fewer than `chars` characters too must recur in `short` texts as they stand; blank lines stay. Repeated rows are treated alike and
    each gives a row; null ids are ids like others. An empty table gives no row. Other columns of docs are not read.
    """
    need(docs, id_col, text)
    found = settle(recurring_lines(docs, id_col, text, depth, texts, fixed, verbatim, tokens, chars, short)).select(F.col("_id").alias("_i"), F.col("_doc").alias("_d"), "_lines")
    own = docs.select(F.col(id_col), F.coalesce(F.col(text), F.lit("")).alias("_text")).withColumn("_doc", F.xxhash64("_text"))
    out = own.join(found, F.col(id_col).eqNullSafe(F.col("_i")) & (F.col("_doc") == F.col("_d")), "left")
    lines = F.split("_text", "\n", -1)
    kept = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains("_lines", i)), "\n")
    return out.select(id_col, F.when(F.col("_lines").isNull(), F.col("_text")).otherwise(kept).alias("kept_text"), F.size(lines).alias("n_lines"), F.when(F.col("_lines").isNull(), 0).otherwise(F.size("_lines")).alias("n_dropped"))


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = drop_template_lines(dealt(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped"), F.sha2("kept_text", 256).alias("kept_sha256"))
