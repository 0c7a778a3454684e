"""Varied scripts for the queries over SQL text: what quotes, brackets, comments and nulls do, checked character by character."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graintide.operators import sqltext
from graintide.plans.instruct import chosen
from graintide.session import dealt, table

QUERIES: dict = {}
ORACLES: dict = {}

#: {k} is a row's key.
SCRIPTS = [
    "CREATE TABLE item_{k} (item_id INT, price DECIMAL(10, 2), qty INTEGER); INSERT INTO item_{k} VALUES (1, 2.5, 3);",
    "create table if not exists shop (shop_id int, rent real, opened date, FOREIGN KEY (shop_id) REFERENCES item(item_id));\nSELECT 1",
    "INSERT INTO log VALUES ('a; b', \"c;d\", `e;f`, {k}); ; ;;\n\n CREATE TABLE log (line VARCHAR(20))",
    "CREATE TABLE t (a INT, note VARCHAR(10) DEFAULT 'x,y', CHECK (a IN (1, 2, 3)))",
    "CREATE TABLE t (a INT, b NUMERIC(4,1), c FLOAT); CREATE VIEW v AS SELECT a FROM t;",
    "CREATE TABLE \"quoted\" (a INT); CREATE TABLE plain (\"first name\" TEXT, `size` INT, total BIGINT)",
    "CREATE TABLE open (a INT, b TEXT DEFAULT 'never closed; CREATE TABLE lost (c INT)",
    "it''s; a 'b''c;d' ; \"e'f;g\" ; `h\"i;j`",
    "",
    " ; \n ;\t; ",
    "CREATE TABLE wide (id INT, year INT, zip NUMBER, customer_id INT, Score DOUBLE, Weight smallint, made TIMESTAMP)",
    "-- a remark; not skipped by the cut\nCREATE TABLE after_remark (x REAL, y REAL)",
    "CREATE TABLE r (a INT /* one; two */, b INT); DROP TABLE r",
    "\n\n  CREATE   TABLE\n spaced_{k}\n(\n  a   INT  NOT   NULL,\n  b\tdecimal ( 8 , 3 ),\n  PRIMARY KEY (a, b)\n)\n;\n",
    "CREATE TABLE deep (a INT CHECK (f(g(a, 1), h(2, 3)) > 0), b REAL, CONSTRAINT u UNIQUE (a, b))",
    "CREATE TABLE one (only)",
    "CREATE TABLE none ()",
    "CREATE TABLE tail_{k} (a INT, b INT) WITH (fill = 70); CREATE INDEX i ON tail_{k} (a);",
    "SELECT ';' ; SELECT \";\" ; SELECT `;`",
    "CREATE TABLE salaries (employee_salary_{k} REAL, tax NUMERIC, age INT); CREATE TABLE weather (conditions TEXT, rain FLOAT)",
    "create temporary table skipped (a int); create table kept_{k} (a int, b int, c int, d int)",
    "CREATE TABLE umlaut (größe REAL, länge REAL, name TEXT DEFAULT 'ü;ö')",
    "PRAGMA foreign_keys = ON; CREATE TABLE p (a INT, b REAL)",
    "CREATE TABLE vac (a TEXT DEFAULT 'vacuum', b INT, c INT); -- attach",
    None,
    "update t set a = 'it''s; {k}' where b = 1; delete from t",
]


def listed(texts: list[str | None]) -> str:
    """A list of texts as SQL that both engines read."""
    return ", ".join("NULL" if t is None else "'" + t.replace("\\", "\\\\").replace("'", "''") + "'" for t in texts)


#: The script of a row of part in DuckDB's SQL.
SCRIPT = f"replace(([{listed(SCRIPTS)}])[1 + p_partkey % {len(SCRIPTS)}], '{{k}}', CAST(p_partkey AS VARCHAR))"
#: Character by character: the kind of the open quote, if any, then what was read, semicolons outside quotes marked.
_READ = "CASE WHEN a[1] = ' ' THEN CASE WHEN c IN ('''', '\"', '`') THEN c || a[2:] || c WHEN c = ';' THEN a || chr(31) ELSE a || c END WHEN c = a[1] THEN ' ' || a[2:] || c ELSE a || c END"
PARTS = f"string_split(list_reduce(string_split(s, ''), lambda a, c: {_READ}, ' ')[2:], chr(31))"
STATEMENTS = f"""WITH q AS (SELECT p_partkey, {SCRIPT} AS s FROM part),
 st AS (SELECT p_partkey, s, CASE WHEN s IS NULL THEN NULL WHEN s = '' THEN [] ELSE list_filter(list_transform({PARTS}, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') END AS parts FROM q)"""
#: The same with the depth of brackets in front, as a character from chr(48) on.
_DEEP = "CASE WHEN c = '(' THEN chr(ascii(a[1]) + 1) || a[2:] || c WHEN c = ')' THEN chr(ascii(a[1]) - 1) || a[2:] || c WHEN c = ',' AND a[1] = '0' THEN a || chr(31) ELSE a || c END"
_HEAD = r"(?is)^create\s+table\s+(?:if\s+not\s+exists\s+)?([A-Za-z_]\w*)\s*\("
TABLES = STATEMENTS + f""", ts AS (SELECT p_partkey, pos, x FROM (SELECT p_partkey, unnest(parts) AS x, generate_subscripts(parts, 1) AS pos FROM st WHERE len(parts) > 0) WHERE regexp_matches(x, '{_HEAD}')),
 bd AS (SELECT p_partkey, pos, regexp_extract(x, '{_HEAD}', 1) AS tb, regexp_replace(regexp_replace(x, '{_HEAD}', ''), '(?s)\\)[^)]*$', '') AS body FROM ts),
 cl AS (SELECT p_partkey, pos, tb, list_filter(list_transform(string_split(CASE WHEN body = '' THEN '' ELSE list_reduce(string_split(body, ''), lambda a, c: {_DEEP}, '0')[2:] END, chr(31)), lambda y: trim(regexp_replace(y, '\\s+', ' ', 'g'))),
   lambda y: contains(y, ' ') AND upper(split_part(y, ' ', 1)) NOT IN ('PRIMARY', 'FOREIGN', 'UNIQUE', 'CONSTRAINT', 'CHECK')) AS cols FROM bd),
 tc AS (SELECT p_partkey, pos, tb, list_transform(cols, lambda y: {{'name': regexp_replace(split_part(y, ' ', 1), '[`"]', '', 'g'), 'type': lower(y[length(split_part(y, ' ', 1)) + 2:])}}) AS cols FROM cl)"""
MEASURES = f"list_transform(list_filter(cols, lambda c: list_contains([{listed(sqltext.NUMERIC)}], regexp_extract(c.type, '^[a-z0-9_]+')) AND NOT list_contains([{listed(sqltext.NO_MEASURE)}], lower(c.name)) AND NOT ends_with(lower(c.name), '_id')), lambda c: c.name)"


def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p_partkey, script: one of the scripts for each part."""
    key = F.col("p_partkey")
    script = F.get(F.array(*map(F.lit, SCRIPTS)), (key % len(SCRIPTS)).cast("int"))
    return dealt(table(spark, sf_dir, "part").select(key)).select(key, F.replace(script, F.lit("{k}"), key.cast("string")).alias("script"))


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


@query(STATEMENTS + " SELECT p_partkey, CAST(len(parts) AS BIGINT) AS n, array_to_string(parts, ' | ') AS parts FROM st")
def varied_statements(spark, sf_dir):
    made = scripts(spark, sf_dir).select("p_partkey", sqltext.statements(F.col("script")).alias("parts"))
    return made.select("p_partkey", F.when(F.col("parts").isNotNull(), F.size("parts")).cast("long").alias("n"), F.array_join("parts", " | ").alias("parts"))


@query(STATEMENTS + " SELECT p_partkey, array_to_string(list_transform(list_filter(parts, lambda x: starts_with(lower(x), 'create')), lambda x: x || ';'), chr(10)) AS schema FROM st")
def varied_schemas(spark, sf_dir):
    return scripts(spark, sf_dir).select("p_partkey", sqltext.schema_of(F.col("script")).alias("schema"))


@query(TABLES + f""" SELECT p_partkey, tb AS "table", array_to_string(list_transform(cols, lambda c: c.name || ' ' || c.type), ' | ') AS columns, array_to_string({MEASURES}, ',') AS measures FROM tc""")
def varied_tables(spark, sf_dir):
    found = scripts(spark, sf_dir).select("p_partkey", F.inline(sqltext.tables_of(F.col("script"))))
    shown = F.array_join(F.transform("columns", lambda c: F.concat_ws(" ", c["name"], c["type"])), " | ")
    return found.select("p_partkey", "table", shown.alias("columns"), F.array_join(sqltext.measures(F.col("columns")), ",").alias("measures"))


@query(TABLES + """, a AS (SELECT p_partkey, pos, tb, unnest(cols).name AS name FROM tc), f AS (SELECT p_partkey, arg_min(tb, pos) AS used FROM tc GROUP BY ALL)
 SELECT p_partkey, coalesce(string_agg(DISTINCT name, ',' ORDER BY name) FILTER (tb <> used AND name NOT IN (SELECT b.name FROM a b WHERE b.p_partkey = a.p_partkey AND b.tb = used)), '') AS missing FROM f LEFT JOIN a USING (p_partkey) GROUP BY p_partkey""")
def varied_foreign_columns(spark, sf_dir):
    """Columns of the tables besides a script's first one."""
    found = scripts(spark, sf_dir).select("p_partkey", sqltext.tables_of(F.col("script")).alias("t")).where(F.size("t") > 0)
    used = F.array(F.get("t", F.lit(0))["table"])
    return found.select("p_partkey", F.array_join(sqltext.foreign_columns(F.col("t"), used), ",").alias("missing"))


FREE = f"list_filter([{listed(sqltext.CONCEPTS)}], lambda n: len(list_filter(string_split(n, ' '), lambda w: length(w) > 3 AND contains(lower(s), w))) = 0)"
_DRAW = "CAST('0x' || substr(md5(CAST(p_partkey AS VARCHAR) || ':concept'), 1, 8) AS BIGINT) % 1000000"


@query(TABLES + f""", n AS (SELECT p_partkey, string_agg(tb, ', ' ORDER BY pos) AS tables FROM tc GROUP BY p_partkey), fr AS (SELECT p_partkey, s, {FREE} AS free FROM st JOIN n USING (p_partkey)),
 pk AS (SELECT p_partkey, free[1 + {_DRAW} % len(free)] AS c FROM fr)
 SELECT p_partkey, replace({chosen(sqltext.MISSING, 'p_partkey', 'question')}, '{{c}}', c) AS question,
 'I can''t answer that from this schema because it has no data about ' || c || '. The available tables are ' || tables || '. If you can point me to the right table or share its schema, I can write the query.' AS answer FROM pk JOIN n USING (p_partkey)""")
def varied_missing_data(spark, sf_dir):
    made = scripts(spark, sf_dir).select("p_partkey", sqltext.missing_data(F.col("script"), F.col("p_partkey")).alias("m")).where("m is not null")
    return made.select("p_partkey", "m.question", "m.answer")
