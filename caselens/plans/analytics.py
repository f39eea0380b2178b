"""Case analytics, incremental indexing and facts over the driver tables: orders, customers and events as cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselens.functions.text import support_number
from caselens.operators import cases, chunking, facts, incremental

from .retrieval import read

AS_OF = "2001-08-05"


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the nation of their customer as the product."""
    orders, customer, nation = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(F.col("n_name").alias("product"), "o_orderkey", "o_orderstatus", "o_orderdate", F.date_format("o_orderdate", "yyyyMMdd").alias("created"))


_CASES = """cases AS (SELECT n_name AS product, o_orderkey, o_orderstatus, o_orderdate, strftime(o_orderdate, '%Y%m%d') AS created
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases.status_summary(_cases(spark, sf_dir), "product", F.col("o_orderstatus") == "O", "o_orderdate", AS_OF)


def status_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases.pivot_with_total(_cases(spark, sf_dir), "product", "o_orderstatus", ["O", "P", "F"])


def product_year_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    seed = read(spark, sf_dir, "nation").select(F.col("n_name").alias("product"))
    return cases.year_cube(_cases(spark, sf_dir), seed, "product", "created")


def monthly_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases.monthly_pivot(_cases(spark, sf_dir), "product", "created", 1996)


def stale_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cases(spark, sf_dir).filter(F.col("o_orderstatus") == "O")
    return rows.filter(cases.is_stale(F.col("o_orderdate"), "1995-03-01", 7)).select("product", "o_orderkey", "created")


def latest_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cases.latest_segment(read(spark, sf_dir, "conversations"), "conv_id", "turn", "turn", "text")
    return rows.select("conv_id", "turn", "role", F.char_length("text").alias("n_chars"))


def best_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.when(F.col("l_returnflag") == "R", 3).when(F.col("l_returnflag") == "A", 2).otherwise(1)
    rows = cases.first_of(read(spark, sf_dir, "lineitem"), ["l_orderkey"], [place.desc(), F.desc("l_shipdate"), "l_linenumber", "l_partkey", "l_suppkey"])
    return rows.select("l_orderkey", "l_returnflag", "l_linenumber", "l_partkey")


def nearest_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    asked = events.filter("event_type = 'error'").select("user_id", "event_id", "ts")
    given = events.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("answer_id"), F.col("ts").alias("answer_ts"))
    return cases.nearest_in_time(asked, given, "user_id", "event_id", "ts", "answer_id", "answer_ts")


def excluded_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excluded customers (those in debt) with their orders, a placeholder where there are none."""
    listed = read(spark, sf_dir, "customer").filter("c_acctbal < 0").select("c_custkey", "c_name")
    orders = read(spark, sf_dir, "orders")
    rows = listed.join(orders, listed["c_custkey"] == orders["o_custkey"], "left")
    return rows.groupBy("c_custkey", "c_name").agg(F.count("o_orderkey").alias("cases"), F.coalesce(F.max("o_orderstatus"), F.lit("(missing)")).alias("status"))


def cases_not_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, listed = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer").filter("c_acctbal < 0")
    rows = orders.join(listed, orders["o_custkey"] == listed["c_custkey"], "left_anti")
    return rows.groupBy("o_orderstatus").agg(F.count("*").alias("cases"))


def two_key_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by key: the customer's orders of a day and priority share the first key, equal prices the second."""
    orders = read(spark, sf_dir, "orders")
    path = F.concat_ws("|", "o_custkey", F.date_format("o_orderdate", "yyyyMM"))
    number = F.when(F.col("o_orderkey") % 7 > 0, F.concat_ws("|", F.date_format("o_orderdate", "yyyyMMdd"), "o_orderstatus"))
    rows = orders.select("o_orderkey", path.alias("path"), number.alias("number"))
    return cases.two_key_dedup(rows, "path", "number", "o_orderkey")


def retained_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("event_type", "ts", "event_id")
    return cases.retained(rows, "ts", "2024-02-05 00:00:00", 30, 500, ["event_type"])


def shadow_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases.shadow_statistics(read(spark, sf_dir, "events"), ["event_type"], "value", F.col("value") < 100)


def mismatch_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases.trailing_failures(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("value") < 40)


def support_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "customer")
    return rows.select("c_custkey", support_number(F.col("c_name")).alias("from_name"), support_number(F.col("c_custkey").cast("string")).alias("from_number"))


def case_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order states as their lines tell them replace those of the orders; lines without order are added."""
    table = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"))
    return cases.upserted(table, _line_states(spark, sf_dir), "key")


def _line_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.min("l_linestatus").alias("lo"), F.max("l_linestatus").alias("hi"))
    return lines.select("key", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise("P").alias("status"))


_LINES = "lines AS (SELECT l_orderkey AS key, CASE WHEN min(l_linestatus) = max(l_linestatus) THEN min(l_linestatus) ELSE 'P' END AS status FROM lineitem GROUP BY l_orderkey)"


def index_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"))
    return incremental.diff(old, _line_states(spark, sf_dir), "key", "status")


def content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each text, by source and doc_id; texts under 40 characters all stay."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("content"), F.char_length("text").alias("size"))
    rows = incremental.first_per_content(docs, F.col("content"), ["source", "doc_id"], F.col("size") < 40)
    return rows.select("doc_id", "source", "content")


def manifest_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.fingerprint(read(spark, sf_dir, "documents"), ["source"], F.concat_ws("|", F.col("doc_id").cast("string"), F.sha2("text", 256)))


def version_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    return incremental.version_conflicts(rows, "p_name", "p_size")


def fact_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"), F.concat(F.col("l_returnflag"), F.col("l_linestatus")).alias("value"), F.col("l_discount").alias("confidence"))
    return facts.resolved(rows)


def facts_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("value"), "o_orderstatus")
    layers = [(name, orders.filter(F.col("o_orderstatus") == s)) for name, s in (("curated", "F"), ("confirmed", "P"), ("found", "O"))]
    return facts.by_priority(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")), layers)


def fact_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    stated = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("value"))
    return facts.disagreements(stated, _line_states(spark, sf_dir).withColumnRenamed("status", "value"))


def technical_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The technical values of each document, with some of every kind behind its text, by its number."""
    n = F.col("doc_id").cast("string")
    more = F.concat(
        F.lit("\nv9."), (F.col("doc_id") % 7).cast("string"), F.lit(".1, HF-"), n, F.lit("; ERR_"), (F.col("doc_id") + 10).cast("string"), F.lit(" https://h/"), n, F.lit("?a=1. C:\\d\\"), n, F.lit(".txt\n/opt/q"), n, F.lit("/bin `run "), n, F.lit("` "),
        (F.col("doc_id") % 9).cast("string"), F.lit(".5 MB and v9."), (F.col("doc_id") % 7).cast("string"), F.lit(".1"),
    )
    rows = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), more).alias("text"))
    return facts.technical_values(rows, "doc_id", "text")


def unsupported_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Technical values of answers that the conversation's other turns do not hold: each turn names a version of its own and a
    hotfix that it shares with the turn before or after."""
    more = F.concat(F.lit(" v"), (F.col("conv_id") % 5).cast("string"), F.lit("."), F.col("turn").cast("string"), F.lit(" HF-"), F.floor(F.col("turn") / 2).cast("string"), F.lit(" "))
    rows = read(spark, sf_dir, "conversations").select("conv_id", "role", F.concat(F.coalesce("text", F.lit("")), F.coalesce(more, F.lit(""))).alias("text"))
    answers = facts.technical_values(rows.filter("role = 'assistant'"), "conv_id", "text").distinct()
    return facts.unsupported(answers, facts.technical_values(rows.filter("role <> 'assistant'"), "conv_id", "text"), ["conv_id"])


def line_normalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.normalised(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", ["quoted_mail", "separator", "greeting"])
    return rows.select("doc_id", F.sha2("text", 256).alias("text_sha256"), "removed_lines")


#: The kinds of technical values with patterns for SQL, whose second group is the value: SQL has no look behind.
_KINDS = {
    "version": r"(?i)(^|[^A-Za-z0-9])(v?\d+(?:\.\d+){1,4}(?:[-+][A-Za-z0-9._-]+)?)", "hotfix": r"(?i)(\b)((?:HF|EP)[-_ ]?\d+[A-Za-z0-9._-]*)\b", "error": r"(?i)(\b)(0x[0-9A-F]+|[A-Z]{1,8}[-_]\d{2,})\b",
    "url": r"""(?i)()(https?://[^\s<>"'']+)""", "windows_path": r"""(\b)([A-Za-z]:\\[^\r\n\t<>"|?*]+)""", "unix_path": r"(^|[^A-Za-z0-9_])(/(?:[A-Za-z0-9._-]+/)+[A-Za-z0-9._-]+)", "quoted": r"()`([^`\r\n]{2,120})`",
    "unit": r"(?i)(^|[^A-Za-z0-9])(\d+(?:\.\d+)?\s*(?:MB|GB|KB|ms|秒|分|%|件|回))\b",
}


def _tech(key: str, rows: str) -> str:
    kinds = ", ".join(f"{{'kind': '{k}', 'vals': regexp_extract_all(text, '{p}', 2)}}" for k, p in _KINDS.items())
    return f"SELECT DISTINCT {key}, kind, value FROM (SELECT {key}, kind, regexp_replace(trim(unnest(vals)), '[.,、。]+$', '') AS value FROM (SELECT {key}, unnest([{kinds}], recursive := true) FROM ({rows}))) WHERE value <> ''"


_VALUED = r"""SELECT doc_id, coalesce(text, '') || chr(10) || 'v9.' || doc_id % 7 || '.1, HF-' || doc_id || '; ERR_' || (doc_id + 10) || ' https://h/' || doc_id || '?a=1. C:\d\' || doc_id || '.txt' || chr(10)
    || '/opt/q' || doc_id || '/bin `run ' || doc_id || '` ' || doc_id % 9 || '.5 MB and v9.' || doc_id % 7 || '.1' AS text FROM documents"""
_TURNS = "SELECT conv_id, role, coalesce(text, '') || coalesce(' v' || conv_id % 5 || '.' || turn || ' HF-' || turn // 2 || ' ', '') AS text FROM conversations"

QUERIES = {
    "status_summary": (
        status_summary,
        f"""WITH {_CASES} SELECT product, count(*) AS total, count(*) FILTER (o_orderstatus = 'O') AS open,
            count(*) FILTER (o_orderstatus = 'O' AND o_orderdate::DATE <= DATE '{AS_OF}' - 7) AS stale, max(o_orderdate) AS last_updated FROM cases GROUP BY product""",
    ),
    "status_pivot": (
        status_pivot,
        f"""WITH {_CASES} SELECT coalesce(product, '(all)') AS product, count(*) FILTER (o_orderstatus = 'O') AS "O", count(*) FILTER (o_orderstatus = 'P') AS "P",
            count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) AS total FROM cases GROUP BY ROLLUP (product)""",
    ),
    "product_year_cube": (
        product_year_cube,
        f"""WITH {_CASES}, r AS (SELECT n_name AS product, created, substr(created, 1, 4) AS year FROM nation LEFT JOIN cases ON n_name = product)
            SELECT coalesce(product, '(all)') AS product, coalesce(year, '(all)') AS year, count(created) AS cases FROM r
            GROUP BY CUBE (product, year) HAVING year IS NOT NULL OR grouping(year) = 1""",
    ),
    "monthly_pivot": (
        monthly_pivot,
        f"""WITH {_CASES} SELECT product, {", ".join(f"count(*) FILTER (substr(created, 5, 2) = '{m:02d}') AS m{m:02d}" for m in range(1, 13))}, count(*) AS total
            FROM cases WHERE substr(created, 1, 4) = '1996' GROUP BY product""",
    ),
    "stale_cases": (
        stale_cases,
        f"WITH {_CASES} SELECT product, o_orderkey, created FROM cases WHERE o_orderstatus = 'O' AND o_orderdate::DATE <= DATE '1995-02-22'",
    ),
    "latest_segment": (
        latest_segment,
        """SELECT conv_id, turn, role, length(text)::INTEGER AS n_chars FROM conversations
            QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY trim(coalesce(text, '')) = '', turn DESC) = 1""",
    ),
    "best_location": (
        best_location,
        """SELECT l_orderkey, l_returnflag, l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey
            ORDER BY CASE l_returnflag WHEN 'R' THEN 3 WHEN 'A' THEN 2 ELSE 1 END DESC, l_shipdate DESC, l_linenumber, l_partkey, l_suppkey) = 1""",
    ),
    "nearest_answer": (
        nearest_answer,
        """SELECT q.user_id, q.event_id, a.event_id AS answer_id FROM (SELECT * FROM events WHERE event_type = 'error') q
            LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') a ON a.user_id = q.user_id
            QUALIFY row_number() OVER (PARTITION BY q.event_id ORDER BY abs(epoch_us(a.ts) - epoch_us(q.ts)), a.ts DESC, a.event_id) = 1""",
    ),
    "excluded_cases": (
        excluded_cases,
        """SELECT c_custkey, c_name, count(o_orderkey) AS cases, coalesce(max(o_orderstatus), '(missing)') AS status
            FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_acctbal < 0 GROUP BY ALL""",
    ),
    "cases_not_excluded": (
        cases_not_excluded,
        "SELECT o_orderstatus, count(*) AS cases FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY 1",
    ),
    "two_key_dedup": (
        two_key_dedup,
        """WITH r AS (SELECT o_orderkey, concat_ws('|', o_custkey, strftime(o_orderdate, '%Y%m')) AS path,
                CASE WHEN o_orderkey % 7 > 0 THEN concat_ws('|', strftime(o_orderdate, '%Y%m%d'), o_orderstatus) END AS number FROM orders),
            p AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY path ORDER BY o_orderkey) = 1)
            SELECT o_orderkey, path, number FROM p QUALIFY number IS NULL OR row_number() OVER (PARTITION BY number ORDER BY o_orderkey) = 1""",
    ),
    "retained_runs": (
        retained_runs,
        """SELECT event_type, ts, event_id FROM events WHERE ts >= TIMESTAMP '2024-02-05' - INTERVAL 30 DAY
            QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) <= 500""",
    ),
    "shadow_statistics": (
        shadow_statistics,
        """SELECT event_type, count(*) AS runs, round(avg((value < 100)::INTEGER), 6) AS match_rate, count(*) FILTER (NOT value < 100) AS failures,
            quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type""",
    ),
    "mismatch_streak": (
        mismatch_streak,
        """WITH r AS (SELECT user_id, value < 40 AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events)
            SELECT user_id, CAST(coalesce(min(n) FILTER (ok) - 1, count(*)) AS BIGINT) AS streak FROM r GROUP BY user_id""",
    ),
    "support_numbers": (
        support_numbers,
        r"""SELECT c_custkey, upper(regexp_replace(c_name, '[^\p{L}\p{Nd}]', '', 'g')) AS from_name,
            CASE WHEN length(c_custkey::VARCHAR) < 8 THEN lpad(c_custkey::VARCHAR, 8, '0') ELSE c_custkey::VARCHAR END AS from_number FROM customer""",
    ),
    "case_upsert": (
        case_upsert,
        f"WITH {_LINES} SELECT * FROM lines UNION ALL SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT key FROM lines)",
    ),
    "index_diff": (
        index_diff,
        f"""WITH {_LINES} SELECT coalesce(o_orderkey, key) AS key, CASE WHEN o_orderkey IS NULL THEN 'added' WHEN key IS NULL THEN 'deleted'
            WHEN status = o_orderstatus THEN 'unchanged' ELSE 'changed' END AS change FROM orders FULL JOIN lines ON o_orderkey = key""",
    ),
    "content_dedup": (
        content_dedup,
        """SELECT doc_id, source, sha256(text) AS content FROM documents
            QUALIFY length(text) < 40 OR row_number() OVER (PARTITION BY sha256(text) ORDER BY source, doc_id) = 1""",
    ),
    "manifest_fingerprints": (
        manifest_fingerprints,
        """WITH d AS (SELECT source, sha256(concat_ws('|', doc_id::VARCHAR, sha256(text))) AS h FROM documents)
            SELECT source, count(*) AS members, sha256(concat_ws(':', count(*)::VARCHAR, sum(('0x' || substr(h, 1, 15))::BIGINT::HUGEINT)::VARCHAR,
                   sum(('0x' || substr(h, 16, 15))::BIGINT::HUGEINT)::VARCHAR)) AS fingerprint FROM d GROUP BY source""",
    ),
    "version_conflicts": (
        version_conflicts,
        "SELECT p_partkey, p_name, p_size, min(p_size) OVER (PARTITION BY p_name) <> max(p_size) OVER (PARTITION BY p_name) AS conflict FROM part",
    ),
    "fact_resolution": (
        fact_resolution,
        """WITH v AS (SELECT l_partkey AS key, l_returnflag || l_linestatus AS value, max(l_discount) AS confidence, count(*) AS sources FROM lineitem GROUP BY ALL)
            SELECT key, value, confidence, CASE WHEN count(*) OVER (PARTITION BY key) = 1 THEN 'Confirmed' ELSE 'Conflict' END AS status, sources FROM v
            QUALIFY row_number() OVER (PARTITION BY key ORDER BY confidence DESC, value) = 1""",
    ),
    "facts_by_priority": (
        facts_by_priority,
        """WITH l AS (SELECT o_custkey AS key, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'P' THEN 1 ELSE 2 END AS p, min(o_orderpriority) AS value FROM orders GROUP BY ALL),
            f AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY key ORDER BY p) = 1)
            SELECT c_custkey AS key, value, coalesce(['curated', 'confirmed', 'found'][p + 1], 'Missing') AS layer FROM customer LEFT JOIN f ON key = c_custkey""",
    ),
    "fact_disagreements": (
        fact_disagreements,
        f"WITH {_LINES} SELECT key, o_orderstatus AS curated_value, status AS found_value FROM orders JOIN lines ON o_orderkey = key WHERE status <> o_orderstatus",
    ),
    "technical_values": (technical_values, _tech("doc_id", _VALUED)),
    "unsupported_claims": (
        unsupported_claims,
        f"""WITH t AS ({_TURNS}), a AS ({_tech("conv_id", "SELECT * FROM t WHERE role = 'assistant'")}), e AS ({_tech("conv_id", "SELECT * FROM t WHERE role <> 'assistant'")})
            SELECT DISTINCT * FROM a ANTI JOIN e USING (conv_id, kind, value)""",
    ),
    "line_normalisation": (
        line_normalisation,
        r"""WITH l AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10))) AS raw,
                generate_subscripts(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)), 1) AS n FROM documents),
            t AS (SELECT doc_id, n, regexp_replace(raw, '\s+$', '') AS line FROM l),
            c AS (SELECT *, max(regexp_matches(trim(line), '(?i)^-{2,}\s*original message\s*-{2,}$')::INTEGER) OVER (PARTITION BY doc_id ORDER BY n) = 1
                    OR starts_with(ltrim(line), '>') OR regexp_matches(trim(line), '(?i)^Dear\s+[^,]+[,]?$') OR regexp_matches(line, '^\s*[-=_*]{5,}\s*$') AS gone FROM t),
            k AS (SELECT *, sum((line <> '')::INTEGER) OVER (PARTITION BY doc_id ORDER BY n) AS run FROM c WHERE NOT gone),
            m AS (SELECT *, row_number() OVER (PARTITION BY doc_id, run, line = '' ORDER BY n) AS nth FROM k),
            s AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY n) AS text FROM m WHERE line <> '' OR nth <= 1 GROUP BY doc_id)
            SELECT c.doc_id, sha256(coalesce(regexp_replace(any_value(s.text), '^\n+|\n+$', '', 'g'), '')) AS text_sha256, count(*) FILTER (gone) AS removed_lines
            FROM c LEFT JOIN s USING (doc_id) GROUP BY c.doc_id""",
    ),
}
