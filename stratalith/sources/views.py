"""Element views over the relational test tables, each with the SQL that says the same.

Every view has the columns doc, pos, id, type, level, md, page, hash and
characters; views that carry links add theirs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalith.functions.columns import element_hash, rstrip

#: A line of at most this many characters reads as a heading.
SHORT_LINE = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _finished(df: DataFrame) -> DataFrame:
    return df.withColumn("hash", element_hash(F.col("type"), F.col("md"))).withColumn("characters", F.length("md").cast("long"))


def doc_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of documents: short ones are headings, of level 1 to 3 by their length."""
    lines = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("doc"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    line = rstrip(F.col("line"))
    lines = lines.select("doc", "pos", line.alias("line")).where("line <> ''")
    level = F.when(F.length("line") <= SHORT_LINE, F.when(F.length("line") <= 15, 1).when(F.length("line") <= 25, 2).otherwise(3))
    els = lines.select("doc", "pos", F.concat("doc", F.lit("#e"), F.col("pos") + 1).alias("id"), level.alias("level"), "line")
    heading = F.col("level").isNotNull()
    els = els.select(
        "doc",
        "pos",
        "id",
        F.when(heading, "heading").otherwise("paragraph").alias("type"),
        "level",
        F.when(heading, F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), "line")).otherwise(F.col("line")).alias("md"),
        F.floor(F.col("pos") / 8).cast("int").alias("page"),
    )
    return _finished(els)


DOC_ELEMENTS = """
    doc_lines as (
        select 'd' || doc_id as doc, unnest(range(len(string_split(text, chr(10)))))::int as pos, unnest(string_split(text, chr(10))) as raw from documents
    ), doc_short as (
        select doc, pos, regexp_replace(raw, '\\s+$', '') as line from doc_lines
    ), doc_typed as (
        select doc, pos, doc || '#e' || (pos + 1) as id,
               case when length(line) <= 15 then 1 when length(line) <= 25 then 2 when length(line) <= 40 then 3 end as level, line
        from doc_short where line <> ''
    ), doc_text as (
        select doc, pos, id, case when level is null then 'paragraph' else 'heading' end as type, level,
               case when level is null then line else repeat('#', level) || ' ' || line end as md, (pos // 8)::int as page
        from doc_typed
    ), doc_elements as (
        select *, substr(sha256(type || chr(10) || md), 1, 16) as hash, length(md) as characters from doc_text
    )"""


def linked_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_elements with types, links, labels and access groups that follow from line lengths.

    Some of the links are broken on purpose, for the constraint checks.
    """
    els = doc_elements(spark, sf_dir)
    n, wd = F.length("md"), Window.partitionBy("doc").orderBy("pos")
    kind = F.when(F.col("type") == "heading", "heading").when(n % 11 == 0, "noise").when(n % 11 == 1, "caption").otherwise("paragraph")
    els = els.withColumn("type", kind).withColumn("hash", F.when(n % 19 == 0, F.lit("0000000000000000")).otherwise(element_hash(F.col("type"), F.col("md"))))
    before = F.lag("id").over(wd)
    els = els.withColumn("before", before)
    return els.select(
        "*",
        F.when((F.col("type") == "caption") & (n % 23 == 0), F.concat("doc", F.lit("#e99999"))).when(F.col("type") == "caption", F.col("before")).alias("reference"),
        F.when((F.col("type") == "paragraph") & (n % 5 == 0), F.col("before")).alias("continues"),
        F.when(n % 17 == 0, F.concat(F.lit("l"), (n % 50).cast("string"))).alias("label"),
        F.when(n % 13 == 0, F.array(F.lit("staff"))).alias("access"),
    ).drop("before")


LINKED_ELEMENTS = (
    DOC_ELEMENTS
    + """, linked_typed as (
        select doc, pos, id, case when type = 'heading' then 'heading' when length(md) % 11 = 0 then 'noise' when length(md) % 11 = 1 then 'caption' else 'paragraph' end as type,
               level, md, page, characters, length(md) as n, lag(id) over (partition by doc order by pos) as before
        from doc_elements
    ), linked_elements as (
        select doc, pos, id, type, level, md, page, characters,
               case when n % 19 = 0 then '0000000000000000' else substr(sha256(type || chr(10) || md), 1, 16) end as hash,
               case when type = 'caption' and n % 23 = 0 then doc || '#e99999' when type = 'caption' then before end as reference,
               case when type = 'paragraph' and n % 5 = 0 then before end as continues,
               case when n % 17 = 0 then 'l' || (n % 50) end as label,
               case when n % 13 = 0 then ['staff'] end as access
        from linked_typed
    )"""
)


def page_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings, paragraphs, list items and footers of web pages, in page order."""
    pattern = r"(?s)<(h1|p|li|footer)[^>]*>(.*?)</"
    pages = table(spark, sf_dir, "pages").where("html is not null")
    both = F.arrays_zip(F.regexp_extract_all("html", F.lit(pattern), F.lit(1)).alias("tag"), F.regexp_extract_all("html", F.lit(pattern), F.lit(2)).alias("text"))
    rows = pages.select(F.concat(F.lit("p"), "page_id").alias("doc"), F.posexplode(both).alias("pos", "x"))
    kind = F.when(F.col("x.tag") == "h1", "heading").when(F.col("x.tag") == "p", "paragraph").when(F.col("x.tag") == "li", "list").otherwise("noise")
    text = F.trim(F.regexp_replace(F.regexp_replace("x.text", "<[^>]*>", ""), "[ \t\r\n]+", " "))
    rows = rows.select("doc", "pos", kind.alias("type"), text.alias("text"))
    md = F.when(F.col("type") == "heading", F.concat(F.lit("# "), "text")).when(F.col("type") == "list", F.concat(F.lit("- "), "text")).otherwise(F.col("text"))
    rows = rows.select("doc", "pos", F.concat("doc", F.lit("#e"), F.col("pos") + 1).alias("id"), "type", F.when(F.col("type") == "heading", 1).alias("level"), md.alias("md"), F.lit(0).alias("page"))
    return _finished(rows)


PAGE_ELEMENTS = r"""
    page_rows as (
        select 'p' || page_id as doc, unnest(range(len(regexp_extract_all(html, '(?s)<(h1|p|li|footer)[^>]*>(.*?)</', 1))))::int as pos,
               unnest(regexp_extract_all(html, '(?s)<(h1|p|li|footer)[^>]*>(.*?)</', 1)) as tag, unnest(regexp_extract_all(html, '(?s)<(h1|p|li|footer)[^>]*>(.*?)</', 2)) as raw
        from pages where html is not null
    ), page_text as (
        select doc, pos, doc || '#e' || (pos + 1) as id, case tag when 'h1' then 'heading' when 'p' then 'paragraph' when 'li' then 'list' else 'noise' end as type,
               trim(regexp_replace(regexp_replace(raw, '<[^>]*>', '', 'g'), '[ \t\r\n]+', ' ', 'g')) as text
        from page_rows
    ), page_md as (
        select doc, pos, id, type, case when type = 'heading' then 1 end as level,
               case type when 'heading' then '# ' || text when 'list' then '- ' || text else text end as md, 0 as page
        from page_text
    ), page_elements as (
        select *, substr(sha256(type || chr(10) || md), 1, 16) as hash, length(md) as characters from page_md
    )"""


def thread_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations: a group of subtype thread, then its messages with the sender on top."""
    turns = table(spark, sf_dir, "conversations").where("conv_id is not null")
    doc = F.concat(F.lit("c"), "conv_id")
    order = Window.partitionBy("doc").orderBy("turn", "role", "text")
    messages = turns.select(doc.alias("doc"), "turn", "role", "text").withColumn("pos", F.row_number().over(order))
    messages = messages.select("doc", "pos", F.lit("message").alias("type"), F.concat(F.lit("**"), F.coalesce("role", F.lit("")), F.lit("**\n\n"), F.coalesce("text", F.lit(""))).alias("md"))
    groups = turns.select(doc.alias("doc")).distinct().select("doc", F.lit(0).alias("pos"), F.lit("group").alias("type"), F.concat(F.lit("Thread "), "doc").alias("md"))
    rows = groups.unionByName(messages)
    return _finished(rows.select("doc", "pos", F.concat("doc", F.lit("#e"), F.col("pos") + 1).alias("id"), "type", F.lit(None).cast("int").alias("level"), "md", F.lit(0).alias("page")))


THREAD_ELEMENTS = """
    thread_rows as (
        select 'c' || conv_id as doc, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first)::int as pos, 'message' as type,
               '**' || coalesce(role, '') || '**' || chr(10) || chr(10) || coalesce(text, '') as md
        from conversations where conv_id is not null
        union all
        select distinct 'c' || conv_id, 0, 'group', 'Thread c' || conv_id from conversations where conv_id is not null
    ), thread_elements as (
        select doc, pos, doc || '#e' || (pos + 1) as id, type, null::int as level, md, 0 as page, substr(sha256(type || chr(10) || md), 1, 16) as hash, length(md) as characters
        from thread_rows
    )"""


def record_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as records: a line per field, ``Name: value``."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    rows = c.join(n, c.c_nationkey == n.n_nationkey)
    line = lambda name, col: F.concat(F.lit(f"{name}: "), F.coalesce(F.col(col).cast("string"), F.lit("")))
    md = F.concat_ws("\n", line("Key", "c_custkey"), line("Name", "c_name"), line("Nation", "n_name"), line("Segment", "c_mktsegment"))
    order = Window.partitionBy("doc").orderBy("c_custkey")
    rows = rows.select(F.concat(F.lit("nation_"), "n_nationkey").alias("doc"), "c_custkey", md.alias("md")).withColumn("pos", F.row_number().over(order) - 1)
    return _finished(rows.select("doc", "pos", F.concat("doc", F.lit("#e"), F.col("pos") + 1).alias("id"), F.lit("record").alias("type"), F.lit(None).cast("int").alias("level"), "md", F.lit(0).alias("page")))


RECORD_ELEMENTS = """
    record_rows as (
        select 'nation_' || n_nationkey as doc, row_number() over (partition by n_nationkey order by c_custkey)::int - 1 as pos,
               'Key: ' || c_custkey || chr(10) || 'Name: ' || c_name || chr(10) || 'Nation: ' || n_name || chr(10) || 'Segment: ' || c_mktsegment as md
        from customer join nation on c_nationkey = n_nationkey
    ), record_elements as (
        select doc, pos, doc || '#e' || (pos + 1) as id, 'record' as type, null::int as level, md, 0 as page, substr(sha256('record' || chr(10) || md), 1, 16) as hash, length(md) as characters
        from record_rows
    )"""


def event_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as records of their user, in time order, with the properties as metadata."""
    e = table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = e.select(F.concat(F.lit("user_"), "user_id").alias("doc"), (F.row_number().over(order) - 1).alias("pos"), F.concat(F.lit("Event: "), "event_type", F.lit("\nId: "), "event_id").alias("md"), F.col("props").alias("meta"))
    out = rows.select("doc", "pos", F.concat("doc", F.lit("#e"), F.col("pos") + 1).alias("id"), F.lit("record").alias("type"), F.lit(None).cast("int").alias("level"), "md", F.lit(0).alias("page"), "meta")
    return _finished(out)


EVENT_ELEMENTS = """
    event_rows as (
        select 'user_' || user_id as doc, row_number() over (partition by user_id order by ts, event_id)::int - 1 as pos, 'Event: ' || event_type || chr(10) || 'Id: ' || event_id as md, props as meta from events
    ), event_elements as (
        select doc, pos, doc || '#e' || (pos + 1) as id, 'record' as type, null::int as level, md, 0 as page, meta,
               substr(sha256('record' || chr(10) || md), 1, 16) as hash, length(md) as characters
        from event_rows
    )"""
