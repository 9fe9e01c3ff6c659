"""Test fixtures bound to the driver's tables (FIXTURES.md).

Each fixture is one SQL text that both Spark and DuckDB run unchanged, so
the Spark query and its DuckDB oracle start from identical rows.  All of them
are pure projections of a base table: their size grows with the table and they
add no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

# F1 accounts: 29 string columns plus row_number, one row per customer.
ACCOUNTS_SQL = """SELECT c_custkey + 1 AS row_number,
 CASE WHEN c_custkey % 97 = 5 THEN repeat('C', 60) ELSE 'C' || lpad(CAST(c_custkey AS VARCHAR(20)), 6, '0') END AS code,
 CASE WHEN c_custkey % 29 = 0 THEN '' WHEN c_custkey % 31 = 1 THEN 'J0hn' WHEN c_custkey % 37 = 2 THEN repeat('a', 51) WHEN c_custkey % 41 = 3 THEN ' José ' ELSE 'Ana' END AS firstname,
 CASE WHEN c_custkey % 43 = 0 THEN '   ' WHEN c_custkey % 47 = 1 THEN 'Smith_7' ELSE 'O''Brien-Díaz' END AS lastname,
 CASE WHEN c_custkey % 23 = 1 THEN '' WHEN c_custkey % 23 = 2 THEN 'no-at-sign' WHEN c_custkey % 23 = 3 THEN 'bad@host' WHEN c_custkey % 23 = 4 THEN 'X' || CAST(c_custkey AS VARCHAR(20)) || '@TempMail.org' WHEN c_custkey % 46 = 5 THEN ' Shared' || CAST(c_nationkey AS VARCHAR(20)) || '@Example.com ' WHEN c_custkey % 46 = 28 THEN 'shared' || CAST(c_nationkey AS VARCHAR(20)) || '@example.com' ELSE 'user' || CAST(c_custkey AS VARCHAR(20)) || '@example.com' END AS email,
 CASE WHEN c_custkey % 19 = 0 THEN '2015-01-01' WHEN c_custkey % 19 = 1 THEN '01/02/2090' WHEN c_custkey % 19 = 2 THEN '15/06/2015' WHEN c_custkey % 19 = 3 THEN '12/31/1980' WHEN c_custkey % 19 = 4 THEN '29/02/2001' ELSE lpad(CAST(c_custkey % 28 + 1 AS VARCHAR(20)), 2, '0') || '/03/' || CAST(1950 + c_custkey % 50 AS VARCHAR(20)) END AS birthdate,
 CASE WHEN c_custkey % 17 = 1 THEN '' WHEN c_custkey % 17 = 2 THEN '1 Main' || chr(10) || 'St' ELSE CAST(c_custkey AS VARCHAR(20)) || ' Main St' END AS address,
 CASE WHEN c_custkey % 13 = 1 THEN '' ELSE 'Lima' END AS city,
 CASE WHEN c_custkey % 11 = 1 THEN '123' ELSE '+51 999 ' || lpad(CAST(c_custkey AS VARCHAR(20)), 6, '0') END AS cellphone,
 '(01) 555-' || lpad(CAST(c_custkey % 10000 AS VARCHAR(20)), 4, '0') AS phone,
 CASE WHEN c_custkey % 26 = 1 THEN 'PER' WHEN c_custkey % 3 = 0 THEN 'pe' WHEN c_custkey % 3 = 1 THEN 'US' ELSE 'ES' END AS countrycode,
 CASE WHEN c_custkey % 4 = 0 THEN 'EN' WHEN c_custkey % 4 = 1 THEN 'es' WHEN c_custkey % 4 = 2 THEN 'zz' ELSE '' END AS languagecode,
 CASE WHEN c_custkey % 14 = 1 THEN 'eng' ELSE 'ES' END AS signuplanguagecode,
 CASE WHEN c_custkey % 15 = 1 THEN 'US' ELSE 'pen' END AS currencycode,
 CASE WHEN c_custkey % 50 = 7 THEN 'Admin' WHEN c_custkey % 50 = 8 THEN 'admin ' ELSE 'u' || CAST(c_custkey AS VARCHAR(20)) END AS username,
 CASE WHEN c_custkey % 5 = 0 THEN 'lima01' WHEN c_custkey % 5 = 1 THEN '15001' WHEN c_custkey % 5 = 2 THEN '150001' WHEN c_custkey % 5 = 3 THEN 'AB-12' ELSE '1!' END AS zip,
 CASE WHEN c_custkey % 21 = 1 THEN '2024.01.01' WHEN c_custkey % 21 = 2 THEN '2090-01-01' ELSE '2024-01-0' || CAST(c_custkey % 9 + 1 AS VARCHAR(20)) END AS signupdate,
 CASE WHEN c_custkey % 12 = 1 THEN 'x' WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS gender,
 CASE WHEN c_custkey % 24 = 1 THEN '' WHEN c_custkey % 24 = 2 THEN 'ESP' WHEN c_custkey % 6 = 0 THEN 'ES' WHEN c_custkey % 6 = 3 THEN ' es' ELSE 'PE' END AS citizenship,
 CASE WHEN c_custkey % 22 = 1 THEN 'R 1' ELSE CAST(c_nationkey AS VARCHAR(20)) END AS regioncode,
 CASE WHEN c_custkey % 20 = 1 THEN 'PROVINCE-TOO-LONG' ELSE 'P' || CAST(c_nationkey AS VARCHAR(20)) END AS provincecode,
 CASE WHEN c_custkey % 18 = 1 THEN 'X' WHEN c_custkey % 18 = 2 THEN 'Lima 1' ELSE 'Lima' END AS province,
 CASE WHEN c_custkey % 7 = 0 THEN '' WHEN c_custkey % 7 = 1 THEN lpad(CAST(c_custkey AS VARCHAR(20)), 8, '0') || 'z' WHEN c_custkey % 7 = 2 THEN 'X' || lpad(CAST(c_custkey AS VARCHAR(20)), 7, '0') || 'A' WHEN c_custkey % 7 = 3 THEN '12' WHEN c_custkey % 7 = 4 THEN 'ID_' || lpad(CAST(c_custkey AS VARCHAR(20)), 6, '0') WHEN c_custkey % 14 = 5 THEN 'DUP-' || lpad(CAST(c_custkey % 41 AS VARCHAR(20)), 4, '0') WHEN c_custkey % 14 = 12 THEN 'dup-' || lpad(CAST(c_custkey % 41 AS VARCHAR(20)), 4, '0') ELSE repeat('9', 21) END AS personalid,
 CASE WHEN c_custkey % 4 = 0 THEN '' WHEN c_custkey % 16 = 1 THEN 'ABC-123' WHEN c_custkey % 16 = 5 THEN 'abc-123' WHEN c_custkey % 16 = 9 THEN '12 4' WHEN c_custkey % 16 = 13 THEN '#12345' ELSE lpad(CAST(c_custkey AS VARCHAR(20)), 8, '0') END AS idcardno,
 CASE WHEN c_custkey % 10 = 0 THEN 'P' || lpad(CAST(c_custkey AS VARCHAR(20)), 7, '0') ELSE '' END AS passportid,
 CASE WHEN c_custkey % 25 = 0 THEN 'DL' || lpad(CAST(c_custkey AS VARCHAR(20)), 8, '0') ELSE '' END AS DRIVERLICENSENO,
 'Lima' AS birthcity,
 CASE WHEN c_custkey % 16 = 3 THEN 'Peru' ELSE 'PE' END AS birthcountrycode,
 CASE WHEN c_custkey % 33 = 0 THEN '' ELSE 'pw' END AS password
FROM customer"""

# F2 raw_lines: undecoded CSV text lines cut from orders into files of 1,000
# lines (so the number of files grows with the table).  Delimiter by file % 4,
# quote by file % 3, a minority delimiter twice per line, and every seventh file
# with a single column (all delimiter counts zero).  o_orderkey is dense from 0,
# so o_orderkey % 1000 + 1 is the line's position in its file; each file's first
# data line also emits the header line (line 0).
_F2_PARTS = """
 'f' || lpad(CAST(CAST(floor(o_orderkey / 1000) AS BIGINT) AS VARCHAR(20)), 5, '0') AS file,
 CAST(floor(o_orderkey / 1000) AS BIGINT) AS fno,
 o_orderkey % 1000 + 1 AS line_no"""
_F2_DIALECT = """
 CASE fno % 4 WHEN 0 THEN ',' WHEN 1 THEN ';' WHEN 2 THEN chr(9) ELSE '|' END AS d,
 CASE fno % 3 WHEN 0 THEN chr(34) WHEN 1 THEN chr(39) ELSE '' END AS q,
 fno % 7 = 6 AS single,
 CASE WHEN fno % 4 = 0 THEN 'a;b;c' ELSE 'a,b,c' END AS note"""
RAW_LINES_SQL = f"""SELECT file, line_no, line FROM (
SELECT file, line_no,
 CASE WHEN single THEN q || CAST(o_orderkey AS VARCHAR(20)) || q
 ELSE q || CAST(o_orderkey AS VARCHAR(20)) || q || d || q || CAST(o_custkey AS VARCHAR(20)) || q || d
   || q || o_orderstatus || q || d || q || o_orderpriority || q || d || q || note || q END AS line
FROM (SELECT *, {_F2_DIALECT} FROM (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, {_F2_PARTS} FROM orders) AS o0) AS o1
UNION ALL
SELECT file, CAST(0 AS BIGINT) AS line_no,
 CASE WHEN single THEN q || 'o_orderkey' || q
 ELSE q || 'o_orderkey' || q || d || q || 'o_custkey' || q || d || q || 'o_orderstatus' || q || d
   || q || 'o_orderpriority' || q || d || q || 'note' || q END AS line
FROM (SELECT *, {_F2_DIALECT} FROM (SELECT o_orderkey, {_F2_PARTS} FROM orders) AS o2 WHERE line_no = 1) AS o3
) AS raw_lines"""

# F3 headers: a header catalogue with one file per customer (file, pos,
# column_name), so the catalogue grows with the table; each file takes one of
# eight header layouts covering exact names, case, separators, the
# customer/user/account/contact prefix, containment both ways, a name that
# normalises to '' and quoted or padded names.
HEADER_LAYOUTS = [
    ["code", "firstname", "lastname", "email"],
    ["Code", "First_Name", "Last Name", "E-Mail"],
    ["customer_code", "user first name", "account-lastname", "contact_email"],
    ["customer", "firstname_txt", "name", "mail"],
    ['"code"', "'firstname'", " lastname ", '"email"'],
    ["CODE", "FIRSTNAME", "LASTNAME", "EMAIL", "birth_date", "City"],
    ["code", "email", "user_name", "zip_code", "cell-phone"],
    ["id", "given name", "surname", "e mail address"],
]


def header_rows() -> list[tuple[int, int, str]]:
    return [(layout, pos, name) for layout, names in enumerate(HEADER_LAYOUTS)
            for pos, name in enumerate(names)]


def _header_values_sql() -> str:
    vals = ", ".join(
        "({}, {}, {})".format(layout, pos, "'" + name.replace("'", "''") + "'")
        for layout, pos, name in header_rows())
    return f"(VALUES {vals}) AS h(layout, pos, column_name)"


HEADERS_SQL = f"""SELECT 'h' || lpad(CAST(c_custkey AS VARCHAR(20)), 7, '0') AS file, h.pos AS pos, h.column_name AS column_name
FROM customer JOIN {_header_values_sql()} ON h.layout = c_custkey % {len(HEADER_LAYOUTS)}"""


def register_tables(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> None:
    """Temp views over the driver's parquet tables (lazy: nothing is read here)."""
    for t in names or TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_tables(spark, sf_dir, ["customer"])
    return spark.sql(ACCOUNTS_SQL)


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_tables(spark, sf_dir, ["orders"])
    return spark.sql(RAW_LINES_SQL)


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_tables(spark, sf_dir, ["customer"])
    return spark.sql(HEADERS_SQL)
