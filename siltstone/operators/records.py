"""Records: extraction by pattern, relational answers over them, the router and its questions.

orders, lineitem, customer and supplier carry the shape of invoices at scale: an order is an invoice, its customer the
vendor, its lines the line items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.catalog import query
from siltstone.session import small, table

# The field patterns of an invoice's text, its line pattern, and the words that send a question to SQL.
MONEY = r"\$([\d,]+\.\d{2})"
FIELDS = {
    "invoice_id": r"\b(INV-\d+)\b",
    "purchase_order": r"Purchase order (PO-\d+)",
    "issue_date": r"(\d{4}-\d{2}-\d{2})",
    "terms": r"(Net \d+|Due on receipt)",
    "subtotal": r"Subtotal\s*\n?" + MONEY,
    "tax": r"Sales tax \([\d.]+%\)\s*\n?" + MONEY,
    "total": r"Total due\s*\n?" + MONEY,
    "status": r"Status: (\w+)",
}
LINE = r"(?m)^([A-Z][^\n$]*?)\n(\d+)\n([a-z]+)\n\$([\d,]+\.\d{2})\n\$([\d,]+\.\d{2})$"
MARKERS = r"(?i)\b(how many|total|sum|average|mean|largest|smallest|count|most|least|exceed|over \$|value of every)\b"
AMOUNTS = ("subtotal", "tax", "total")


def money(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit("")).cast("double")


def extract_records(docs: DataFrame, vendors: list[str], customers: list[str], text: str = "text") -> DataFrame:
    """docs with one column a field, and line_items: an array of structs. A field without a match is null.

    The vendor is the first line if it is one of vendors; the customer is the first of customers that the text has.
    """
    t = F.col(text)
    found = {n: F.nullif(F.regexp_extract(t, p, 1), F.lit("")) for n, p in FIELDS.items()}
    dates = F.regexp_extract_all(t, F.lit(FIELDS["issue_date"]), F.lit(1))
    first = F.element_at(F.split(F.trim(t), "\n"), 1)
    part = lambda i: F.regexp_extract_all(t, F.lit(LINE), F.lit(i))
    lines = F.transform(F.arrays_zip(*[part(i).alias(f"c{i}") for i in range(1, 6)]), lambda z: F.struct(z["c1"].alias("description"), z["c2"].cast("int").alias("quantity"), z["c3"].alias("uom"), money(z["c4"]).alias("unit_price"), money(z["c5"]).alias("amount")))
    listed = F.array(*[F.lit(c) for c in customers]) if customers else F.array().cast("array<string>")
    return docs.select(
        "*",
        *[(money(c) if n in AMOUNTS else c).alias(n) for n, c in found.items()],
        F.try_element_at(dates, F.lit(2)).alias("due_date"),
        F.when(first.isin(vendors), first).alias("vendor"),
        F.get(F.filter(listed, lambda c: F.contains(t, c)), F.lit(0)).alias("customer"),
        lines.alias("line_items"),
    )


def last_wins(records: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key: that with the largest order."""
    best = records.groupBy(key).agg(F.max_by(F.struct("*"), order).alias("_r"))
    return best.select("_r.*")


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    status = F.when(F.col("o_orderstatus") == "F", "paid").when(F.col("o_orderstatus") == "O", "open").otherwise("overdue")
    return orders.join(small(customers), F.col("o_custkey") == F.col("c_custkey"), "left").select(F.col("o_orderkey").alias("invoice_id"), F.col("c_name").alias("vendor"), F.col("o_totalprice").alias("total"), status.alias("status"), F.col("o_orderdate").alias("issue_date"))


_INV = "i AS (SELECT o_orderkey AS invoice_id, c_name AS vendor, o_totalprice AS total, CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'O' THEN 'open' ELSE 'overdue' END AS status FROM orders LEFT JOIN customer ON o_custkey = c_custkey)"
_VENDOR = "Customer#000000007"


def route(question: Column) -> Column:
    """sql for questions with an aggregate's word, else retrieval."""
    return F.when(F.regexp_like(question, F.lit(MARKERS)), "sql").otherwise("retrieval")


def shape(question: Column) -> Column:
    """Which statement answers a question, or null; the first that fits."""
    has = lambda s: F.contains(question, F.lit(s))
    return (
        F.when(F.regexp_like(question, F.lit(r"total across all invoices from .+?\?")), "sum_vendor")
        .when(F.regexp_like(question, F.lit(r"How many invoices did .+? issue\?")), "count_vendor")
        .when(F.regexp_like(question, F.lit(r"How many invoices exceed \$[\d,]+\?")), "count_over")
        .when(has("largest total"), "largest")
        .when(has("total value of every invoice"), "grand_total")
        .when(has("average invoice total"), "mean_total")
        .when(has("overdue"), "overdue")
        .when(has("servo motors"), "child_sum")
    )


def answer(question: str, records: DataFrame, lines: DataFrame, child: str = "Servo motor") -> DataFrame:
    """One row, answer as text, null if no statement fits; the shape is chosen on the driver, the statement runs as a plan."""
    import re

    spark = records.sparkSession
    text = lambda df: df.select(F.col("a").cast("string").alias("answer"))
    two = lambda c: F.round(c, 2).cast("decimal(38,2)").alias("a")
    if m := re.search(r"total across all invoices from (.+?)\?", question):
        return text(records.where(F.col("vendor") == m[1]).agg(two(F.sum("total"))))
    if m := re.search(r"How many invoices did (.+?) issue\?", question):
        return text(records.where(F.col("vendor") == m[1]).agg(F.count("*").alias("a")))
    if m := re.search(r"How many invoices exceed \$([\d,]+)\?", question):
        return text(records.where(F.col("total") > float(m[1].replace(",", ""))).agg(F.count("*").alias("a")))
    for mark, make in (
        ("largest total", lambda: records.orderBy(F.desc_nulls_last("total"), "invoice_id").limit(1).select(F.col("invoice_id").alias("a"))),
        ("total value of every invoice", lambda: records.agg(two(F.sum(F.col("total").cast("decimal(18,2)"))))),  # exact: a sum of doubles is off by cents over millions of them
        ("average invoice total", lambda: records.agg(two(F.avg("total")))),
        ("overdue", lambda: records.where("status = 'overdue'").agg(F.count("*").alias("a"))),
        ("servo motors", lambda: lines.where(F.ilike("description", F.lit(f"{child}%"))).agg(F.sum("quantity").alias("a"))),
    ):
        if mark in question:
            return text(make())
    return spark.range(1).select(F.lit(None).cast("string").alias("answer"))


def describe(question: str, records: DataFrame, lines: DataFrame, k: int = 4) -> DataFrame:
    """invoice_id of records that a purchase order in the question names, else of lines that hold its last three longer words in order."""
    import re

    if m := re.search(r"\b(PO-\d+)\b", question):
        named = records.where(F.col("purchase_order") == m[1]).select("invoice_id")
        if named.limit(1).count():
            return named
    words = [w for w in re.findall("[a-z0-9]+", question.lower()) if len(w) > 3][-3:]
    return lines.where(F.ilike("description", F.lit("%" + "%".join(words) + "%"))).select("invoice_id").distinct().orderBy("invoice_id").limit(k)


def required(question: str, records: DataFrame, vendors: list[str]) -> DataFrame:
    """invoice_id of the records that one must see to answer a question."""
    import re

    if vendor := next((v for v in vendors if v in question), None):
        records = records.where(F.col("vendor") == vendor)
    elif m := re.search(r"exceed \$([\d,]+)", question):
        records = records.where(F.col("total") > float(m[1].replace(",", "")))
    elif "overdue" in question:
        records = records.where("status = 'overdue'")
    return records.select("invoice_id")


QUESTIONS = (
    (1, f"What is the total across all invoices from {_VENDOR}?"),
    (2, f"How many invoices did {_VENDOR} issue?"),
    (3, "How many invoices exceed $20,000?"),
    (4, "Which invoice has the largest total?"),
    (5, "What is the total value of every invoice?"),
    (6, "What is the average invoice total?"),
    (7, "How many invoices are overdue?"),
    (8, "Which invoice mentions hydraulic hose?"),
)


def _questions(spark):
    return spark.createDataFrame(QUESTIONS, "id int, question string")


_QSQL = "(VALUES " + ", ".join(f"({i}, '{q}')" for i, q in QUESTIONS) + ") q(id, question)"


@query("sum_vendor", f"WITH {_INV} SELECT round(sum(total), 2) AS total FROM i WHERE vendor = '{_VENDOR}'")
def sum_vendor(spark, sf_dir):
    return invoices(spark, sf_dir).where(F.col("vendor") == _VENDOR).agg(F.round(F.sum("total"), 2).alias("total"))


@query("count_vendor", f"WITH {_INV} SELECT count(*) AS n FROM i WHERE vendor = '{_VENDOR}'")
def count_vendor(spark, sf_dir):
    return invoices(spark, sf_dir).where(F.col("vendor") == _VENDOR).agg(F.count("*").alias("n"))


@query("count_over", f"WITH {_INV} SELECT count(*) FILTER (total > 5000) AS over_5000, count(*) FILTER (total > 10000) AS over_10000, count(*) FILTER (total > 20000) AS over_20000 FROM i")
def count_over(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(*[F.count_if(F.col("o_totalprice") > n).alias(f"over_{n}") for n in (5000, 10_000, 20_000)])


@query("status_count", f"WITH {_INV} SELECT status, count(*) AS n FROM i GROUP BY status")
def status_count(spark, sf_dir):
    return invoices(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


@query("top_invoice", f"WITH {_INV} SELECT invoice_id, total FROM i ORDER BY total DESC NULLS LAST, invoice_id LIMIT 1")
def top_invoice(spark, sf_dir):
    return invoices(spark, sf_dir).select("invoice_id", "total").orderBy(F.desc_nulls_last("total"), "invoice_id").limit(1)


@query("grand_total", "SELECT round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 2) AS mean FROM orders")
def grand_total(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(F.round(F.sum(F.col("o_totalprice").cast("decimal(18,2)")), 2).cast("double").alias("total"), F.round(F.avg("o_totalprice"), 2).alias("mean"))


@query("child_like_sum", "SELECT sum(l_quantity)::BIGINT AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type ILIKE 'promo%'")
def child_like_sum(spark, sf_dir):
    parts = table(spark, sf_dir, "part").where(F.ilike("p_type", F.lit("promo%"))).select("p_partkey")
    return table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity").join(small(parts), F.col("l_partkey") == F.col("p_partkey"), "left_semi").agg(F.sum(F.col("l_quantity").cast("long")).alias("quantity"))


@query("vendor_rollup", f"WITH {_INV} SELECT vendor, round(sum(total), 2) AS total, count(*) AS n FROM i GROUP BY vendor")
def vendor_rollup(spark, sf_dir):
    return invoices(spark, sf_dir).groupBy("vendor").agg(F.round(F.sum("total"), 2).alias("total"), F.count("*").alias("n"))


@query("max_line", "SELECT l_orderkey AS invoice_id, arg_max(l_linenumber, (l_extendedprice, -l_linenumber)) AS line, max(l_extendedprice) AS amount FROM lineitem GROUP BY 1")
def max_line(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("invoice_id")).agg(F.max_by("l_linenumber", F.struct("l_extendedprice", -F.col("l_linenumber"))).alias("line"), F.max("l_extendedprice").alias("amount"))


@query("upsert_last_wins", "SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def upsert_last_wins(spark, sf_dir):
    return last_wins(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), "user_id", "event_id")


@query("like_ordered", "SELECT doc_id FROM documents WHERE text ILIKE '%the%then%there%'")
def like_ordered(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.ilike("text", F.lit("%the%then%there%"))).select("doc_id")


@query("route", f"SELECT id, CASE WHEN regexp_matches(question, '{MARKERS[4:]}', 'i') THEN 'sql' ELSE 'retrieval' END AS store FROM {_QSQL}")
def q_route(spark, sf_dir):
    return _questions(spark).select("id", route(F.col("question")).alias("store"))


@query("dispatch", f"SELECT id, CASE WHEN regexp_matches(question, 'total across all invoices from .+?\\?') THEN 'sum_vendor' WHEN regexp_matches(question, 'How many invoices did .+? issue\\?') THEN 'count_vendor' WHEN regexp_matches(question, 'How many invoices exceed \\$[\\d,]+\\?') THEN 'count_over' WHEN contains(question, 'largest total') THEN 'largest' WHEN contains(question, 'total value of every invoice') THEN 'grand_total' WHEN contains(question, 'average invoice total') THEN 'mean_total' WHEN contains(question, 'overdue') THEN 'overdue' WHEN contains(question, 'servo motors') THEN 'child_sum' END AS shape FROM {_QSQL}")
def dispatch(spark, sf_dir):
    return _questions(spark).select("id", shape(F.col("question")).alias("shape"))


@query("routed_answers", f"""WITH {_INV} SELECT 1 AS id, (SELECT sum(total)::DECIMAL(38,2)::VARCHAR FROM i WHERE vendor = '{_VENDOR}') AS answer
UNION ALL SELECT 2, (SELECT count(*)::VARCHAR FROM i WHERE vendor = '{_VENDOR}') UNION ALL SELECT 3, (SELECT count(*)::VARCHAR FROM i WHERE total > 20000)
UNION ALL SELECT 4, (SELECT invoice_id::VARCHAR FROM i ORDER BY total DESC, invoice_id LIMIT 1) UNION ALL SELECT 5, (SELECT sum(total::DECIMAL(18,2))::VARCHAR FROM i)
UNION ALL SELECT 6, (SELECT round(avg(total), 2)::DECIMAL(38,2)::VARCHAR FROM i) UNION ALL SELECT 7, (SELECT count(*)::VARCHAR FROM i WHERE status = 'overdue')""")
def routed_answers(spark, sf_dir):
    """The questions that the router sends to SQL, answered there."""
    records = invoices(spark, sf_dir)
    lines = spark.createDataFrame([], "invoice_id long, description string, quantity int")
    parts = [answer(q, records, lines).select(F.lit(i).alias("id"), "answer") for i, q in QUESTIONS[:7]]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


@query("required_docs", f"WITH {_INV} SELECT 1 AS id, count(*) AS n FROM i WHERE vendor = '{_VENDOR}' UNION ALL SELECT 3, count(*) FROM i WHERE total > 20000 UNION ALL SELECT 5, count(*) FROM i UNION ALL SELECT 7, count(*) FROM i WHERE status = 'overdue'")
def required_docs(spark, sf_dir):
    records = invoices(spark, sf_dir)
    parts = [required(q, records, [_VENDOR]).agg(F.lit(i).alias("id"), F.count("*").alias("n")) for i, q in QUESTIONS if i in (1, 3, 5, 7)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


@query("money", "SELECT o_orderkey, o_totalprice AS amount FROM orders")
def q_money(spark, sf_dir):
    """Amounts printed with thousands' commas and read again."""
    printed = F.format_number("o_totalprice", 2)
    return table(spark, sf_dir, "orders").select("o_orderkey", money(printed).alias("amount"))


@query("distinctive_answers", "SELECT o_orderkey, (o_totalprice >= 1000) AS distinctive FROM orders")
def distinctive_answers(spark, sf_dir):
    """Whether an amount, printed with two digits, can be found as text: it is 1,000 or more and the cleaned text holds it."""
    text = F.concat(F.lit("Total due $"), F.format_number("o_totalprice", 2))
    found = F.contains(F.regexp_replace(text, "[$,]", ""), F.format_string("%.2f", "o_totalprice"))
    return table(spark, sf_dir, "orders").select("o_orderkey", ((F.col("o_totalprice") >= 1000) & found).alias("distinctive"))


def invoice_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orderkey, vendor, customer, total, status, text: each order printed as an invoice, its lines in order. A seventh of them, by key, have no status, an eleventh a broken total."""
    cents = lambda c: F.concat(F.lit("$"), F.format_number(c, 2))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("at"), F.concat_ws("\n", F.concat(F.lit("Part "), F.col("l_partkey").cast("string")), F.col("l_quantity").cast("int").cast("string"), F.lit("ea"), cents(F.col("l_extendedprice") / F.col("l_quantity")), cents(F.col("l_extendedprice"))).alias("line"))
    listed = lines.groupBy("k").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    inv, key = invoices(spark, sf_dir), F.col("invoice_id")
    id_ = F.concat(F.lit("INV-"), key.cast("string"))
    total = F.when(key % 11 == 0, F.lit("$?")).otherwise(cents(F.col("total")))
    state = F.when(key % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("Status: "), "status"))
    day = F.date_format("issue_date", "yyyy-MM-dd")
    text = F.concat_ws("\n", "vendor", F.concat(F.lit("Invoice "), id_, F.lit(" for Ridgeline Analytics")), F.concat(day, F.lit(" "), day, F.lit(" Net 30 Purchase order PO-"), key.cast("string")), "lines", F.lit("Total due"), total, state)
    return inv.join(listed, key == F.col("k"), "left").select(key.alias("orderkey"), F.col("vendor").alias("true_vendor"), F.col("total").alias("true_total"), F.col("status").alias("true_status"), text.alias("text"))


def _read_back(spark, sf_dir) -> DataFrame:
    """invoice_texts with the fields that extraction finds. Vendors are told by their own table, not by a list."""
    return extract_records(invoice_texts(spark, sf_dir), [], ["Ridgeline Analytics"])


@query("invoice_records", "SELECT o_orderkey AS orderkey, 'INV-' || o_orderkey AS invoice_id, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE round(o_totalprice, 2) END AS total, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'paid' WHEN o_orderstatus = 'O' THEN 'open' ELSE 'overdue' END AS status, coalesce(n, 0) AS n_lines, quantity FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, sum(l_quantity)::BIGINT AS quantity FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def invoice_records(spark, sf_dir):
    """Records read back from the invoices' texts."""
    quantity = F.when(F.size("line_items") > 0, F.aggregate("line_items", F.lit(0).cast("long"), lambda a, x: a + x["quantity"]))
    return _read_back(spark, sf_dir).select("orderkey", "invoice_id", "total", "status", F.size("line_items").cast("long").alias("n_lines"), quantity.alias("quantity"))


@query("field_accuracy", """WITH t AS (SELECT o_orderkey AS k, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT round(avg((k % 11 <> 0)::INT), 6) AS total, round(avg((k % 7 <> 0)::INT), 6) AS status, 1e0 AS line_count, count(*) AS n FROM t""")
def field_accuracy(spark, sf_dir):
    """Share of invoices whose field is read as it is: total within half a cent, status, number of lines."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n"))
    both = _read_back(spark, sf_dir).join(lines, F.col("orderkey") == F.col("k"), "left")
    share = lambda c: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("int")), 6)
    return both.agg(share(F.abs(F.col("total") - F.col("true_total")) < 0.005).alias("total"), share(F.col("status") == F.col("true_status")).alias("status"), share(F.size("line_items") == F.coalesce("n", F.lit(0))).alias("line_count"), F.count("*").alias("n"))


@query("upsert_children", "WITH e AS (SELECT user_id, event_id, event_type FROM events), k AS (SELECT user_id, max(event_id) AS last FROM e GROUP BY 1) SELECT k.user_id, last, count(*) AS children FROM k JOIN e USING (user_id) GROUP BY 1, 2")
def upsert_children(spark, sf_dir):
    """Of records with one key the last stays, and the child rows of those it replaced stay too."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    last = last_wins(rows, "user_id", "event_id").select("user_id", F.col("event_id").alias("last"))
    return last.join(rows, "user_id").groupBy("user_id", "last").agg(F.count("*").alias("children"))


def _answered(spark, sf_dir) -> DataFrame:
    """id, retrieval and sql: each question's answer by the invoices' lines that hold its last words, and by a statement, null where there is none."""
    records = invoices(spark, sf_dir)
    lines = spark.createDataFrame([], "invoice_id long, description string, quantity int")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.concat(F.lit("List of "), F.col("p_type"), F.lit(" parts")).alias("description"))
    typed = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("invoice_id"), "l_partkey").join(parts, F.col("l_partkey") == F.col("k")).select("invoice_id", "description")
    named = records.withColumn("purchase_order", F.lit(None).cast("string"))
    out = None
    for i, q in ASKED:
        sql = answer(q, records, lines).select(F.lit(i).alias("id"), F.col("answer").alias("sql"))
        found = describe(q, named, typed).agg(F.array_join(F.sort_array(F.collect_list("invoice_id")).cast("array<string>"), ",").alias("retrieval"))
        row = sql.join(F.broadcast(found)).select("id", "sql", F.nullif("retrieval", F.lit("")).alias("retrieval"))
        out = row if out is None else out.unionAll(row)
    return out


#: Two questions for a statement, and one that only the lines can answer.
ASKED = ((1, QUESTIONS[0][1]), (2, QUESTIONS[6][1]), (3, "Which invoices list promo parts?"))
_ASKED = "(VALUES " + ", ".join(f"({i}, '{q}')" for i, q in ASKED) + ") q(id, question)"
_FOUND = "SELECT string_agg(k::VARCHAR, ',' ORDER BY k) FROM (SELECT DISTINCT l_orderkey AS k FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type ILIKE '%promo%' ORDER BY k LIMIT 4)"


@query("answers_by_route", f"""WITH {_INV} SELECT id, CASE WHEN regexp_matches(question, '{MARKERS[4:]}', 'i') OR id = 2 THEN 'sql' ELSE 'retrieval' END AS store,
CASE id WHEN 1 THEN (SELECT sum(total)::DECIMAL(38,2)::VARCHAR FROM i WHERE vendor = '{_VENDOR}') WHEN 2 THEN (SELECT count(*)::VARCHAR FROM i WHERE status = 'overdue') ELSE ({_FOUND}) END AS answer FROM {_ASKED}""")
def answers_by_route(spark, sf_dir):
    """Each question goes to the store that its words name and gets that store's answer."""
    asked = spark.createDataFrame(ASKED, "id int, question string").select("id", route(F.col("question")).alias("store"))
    both = asked.join(_answered(spark, sf_dir), "id")
    return both.select("id", "store", F.when(F.col("store") == "sql", F.col("sql")).otherwise(F.col("retrieval")).alias("answer"))


@query("end_to_end_scores", f"""WITH {_INV}, q AS (SELECT id, regexp_matches(question, '{MARKERS[4:]}', 'i') AS sql, id = 3 AS lines FROM {_ASKED}),
n AS (SELECT (SELECT count(*) FROM i WHERE vendor = '{_VENDOR}') > 0 AS vendor_there, ({_FOUND}) IS NOT NULL AS found)
SELECT round(avg((lines AND found)::INT), 6) AS retrieval_only, round(avg((sql AND (id <> 1 OR vendor_there))::INT), 6) AS sql_only, round(avg((CASE WHEN sql THEN id <> 1 OR vendor_there ELSE lines AND found END)::INT), 6) AS routed FROM q, n""")
def end_to_end_scores(spark, sf_dir):
    """Share of questions that each store answers as the other means says: totals for statements, a scan of the lines for retrieval. Retrieval has no totals."""
    records = invoices(spark, sf_dir)
    parts = table(spark, sf_dir, "part").where(F.ilike("p_type", F.lit("%promo%"))).select(F.col("p_partkey").alias("k"))
    held = table(spark, sf_dir, "lineitem").join(small(parts), F.col("l_partkey") == F.col("k"), "left_semi").select(F.col("l_orderkey").alias("k")).distinct().orderBy("k").limit(4)
    truth = [records.where(F.col("vendor") == _VENDOR).agg(F.round(F.sum("total"), 2).cast("decimal(38,2)").cast("string").alias("t")), records.groupBy("status").count().where("status = 'overdue'").select(F.col("count").cast("string").alias("t")), held.agg(F.array_join(F.sort_array(F.collect_list("k")).cast("array<string>"), ",").alias("t"))]
    rows = truth[0].select(F.lit(1).alias("id"), "t").unionAll(truth[1].select(F.lit(2), "t")).unionAll(truth[2].select(F.lit(3), "t"))
    routed = answers_by_route(spark, sf_dir).select("id", F.col("answer").alias("routed"))
    each = rows.join(_answered(spark, sf_dir), "id").join(routed, "id")
    share = lambda c: F.round(F.avg(F.coalesce(F.col(c) == F.col("t"), F.lit(False)).cast("int")), 6)
    return each.agg(share("retrieval").alias("retrieval_only"), share("sql").alias("sql_only"), share("routed").alias("routed"))
