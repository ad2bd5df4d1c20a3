"""Named queries over the element views, with the SQL that states each of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalith.functions import columns as C
from stratalith.operators import chunking, constraints, quality, retrieval, structure
from stratalith.sources import views as V
from stratalith.storage import materialize

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None, views: str = ""):
    """Registers a query under its function's name; ``views`` are the CTEs that its SQL stands on."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            recursive = "recursive " if "recursive" in sql[:40] else ""
            body = sql.replace("recursive", "", 1) if recursive else sql
            joined = f"with {recursive}{views}" + (", " if views and body.lstrip().startswith(",,") else " ")
            ORACLES[f.__name__] = joined + body.lstrip().removeprefix(",,") if views else body
        return f

    return register


ELEMENT = "doc, pos, id, type, level, md, page, hash, characters"


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """linked_elements, written once for operators that read them several times."""
    return materialize(V.linked_elements(spark, sf_dir), "linked")


def _elements(df: DataFrame) -> DataFrame:
    return df.select(*ELEMENT.split(", "))


@query(f"select {ELEMENT} from doc_elements", V.DOC_ELEMENTS)
def doc_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _elements(V.doc_elements(spark, sf_dir))


@query(f"select {ELEMENT} from page_elements", V.PAGE_ELEMENTS)
def page_elements(spark, sf_dir):
    return _elements(V.page_elements(spark, sf_dir))


@query(f"select {ELEMENT} from thread_elements", V.THREAD_ELEMENTS)
def thread_elements(spark, sf_dir):
    return _elements(V.thread_elements(spark, sf_dir))


@query(f"select {ELEMENT} from record_elements", V.RECORD_ELEMENTS)
def record_elements(spark, sf_dir):
    return _elements(V.record_elements(spark, sf_dir))


@query(f"select {ELEMENT}, meta from event_elements", V.EVENT_ELEMENTS)
def event_elements(spark, sf_dir):
    return V.event_elements(spark, sf_dir).select(*ELEMENT.split(", "), "meta")


@query("select doc, hash, count(*) as copies from doc_elements group by doc, hash", V.DOC_ELEMENTS)
def element_hash(spark, sf_dir):
    return V.doc_elements(spark, sf_dir).groupBy("doc", "hash").agg(F.count("*").alias("copies"))


@query("select type, count(*) as elements, sum(characters)::bigint as characters, max(characters) as longest from page_elements group by type", V.PAGE_ELEMENTS)
def element_characters(spark, sf_dir):
    e = V.page_elements(spark, sf_dir)
    return e.groupBy("type").agg(F.count("*").alias("elements"), F.sum("characters").alias("characters"), F.max("characters").alias("longest"))


@query("select id, split_part(id, '#', 2) as short, regexp_extract(id, '#e([0-9]+)$', 1)::bigint as number, doc || '#' || split_part(id, '#', 2) as whole from doc_elements", V.DOC_ELEMENTS)
def element_ids(spark, sf_dir):
    e = V.doc_elements(spark, sf_dir)
    short = C.short_id(F.col("id"), F.col("doc"))
    return e.select("id", short.alias("short"), C.id_number(F.col("id")).alias("number"), C.full_id(short, F.col("doc")).alias("whole"))


_ROUGH = """rough as (
        select doc_id, '##   ' || replace(replace(text, '. ', '.  ' || chr(10) || '* '), ',', chr(9)) || ' ##  ' || chr(10) || chr(10) as md from documents
    )"""


@query(
    r"""select doc_id, length(list_text)::int as list_length, sha256(list_text) as list_sha, length(head_text)::int as head_length, sha256(head_text) as head_sha from (
        select doc_id, regexp_replace(lines, '(^|\n)([ \t]*)[*+](\s)', '\1\2-\3', 'g') as list_text,
               regexp_extract(first, '^(#{1,6})', 1) || ' ' || trim(regexp_replace(regexp_extract(first, '^#{1,6}\s*(.*)$', 1), '(^|\s)#+$', ''), ' ' || chr(9)) || substr(lines, length(first) + 1) as head_text
        from (select doc_id, lines, string_split(lines, chr(10))[1] as first from (
            select doc_id, regexp_replace(regexp_replace(array_to_string(list_transform(string_split(md, chr(10)),
                lambda s: case when s like '%  ' and regexp_replace(s, '\s+$', '') <> '' then regexp_replace(s, '\s+$', '') || chr(92) else regexp_replace(s, '\s+$', '') end), chr(10)), '^\n+', ''), '\n+$', '') as lines
            from rough)))""",
    _ROUGH,
)
def canonical_text(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents")
    md = F.concat(F.lit("##   "), F.replace(F.replace("text", F.lit(". "), F.lit(".  \n* ")), F.lit(","), F.lit("\t")), F.lit(" ##  \n\n"))
    rough = docs.select("doc_id", md.alias("md"))
    both = rough.select("doc_id", C.canonical_text(F.lit("list"), F.col("md")).alias("l"), C.canonical_text(F.lit("heading"), F.col("md")).alias("h"))
    return both.select("doc_id", F.length("l").alias("list_length"), F.sha2("l", 256).alias("list_sha"), F.length("h").alias("head_length"), F.sha2("h", 256).alias("head_sha"))


@query(
    r"""select doc_id, k::int as k, case when regexp_matches(b, '^#{1,6}([ \t]|$|\n)') then 'heading' when regexp_matches(b, '^ {0,3}(`{3,}|~{3,})') then 'code' when b like '|%' then 'table'
        when b like '$$%' and b like '%$$' and length(b) >= 4 then 'formula' when regexp_matches(b, '^!\[.*\]\(\S+\)$') then 'image' when b like '>%' then 'quote'
        when regexp_matches(b, '^([-*+]|[0-9]+[.)])\s') then 'list' else 'paragraph' end as type
    from (select doc_id, unnest(range(8)) as k, unnest(['# ' || t, '```' || t, '| ' || t || ' |', '$$' || t || '$$', '![' || t || '](images/a.png)', '> ' || t, '1. ' || t, t]) as b
          from (select doc_id, regexp_replace(text, '\s+', ' ', 'g') as t from documents))"""
)
def detect_types(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r"\s+", " ").alias("t"))
    forms = F.array(*[F.concat(F.lit(a), "t", F.lit(b)) for a, b in (("# ", ""), ("```", ""), ("| ", " |"), ("$$", "$$"), ("![", "](images/a.png)"), ("> ", ""), ("1. ", ""), ("", ""))])
    return docs.select("doc_id", F.posexplode(forms).alias("k", "b")).select("doc_id", "k", C.detect_type(F.col("b")).alias("type"))


@query("select c_custkey, '| ' || c_name || ' | ' || replace(c_mktsegment, 'I', chr(92) || '|') || ' | ' || c_nationkey || ' |' as line from customer")
def pipe_row_render(spark, sf_dir):
    c = V.table(spark, sf_dir, "customer")
    return c.select("c_custkey", C.pipe_row(F.array("c_name", F.replace("c_mktsegment", F.lit("I"), F.lit("\\|")), F.col("c_nationkey").cast("string"))).alias("line"))


@query(
    r"""select c_custkey, len(cells)::int as n_cells, trim(replace(cells[2], chr(1), chr(92) || '|')) as second from (
        select c_custkey, string_split(regexp_replace(regexp_replace(replace('| ' || c_name || ' | ' || replace(c_mktsegment, 'I', chr(92) || '|') || ' |', chr(92) || '|', chr(1)), '^\|', ''), '\|$', ''), '|') as cells from customer)"""
)
def pipe_row_split(spark, sf_dir):
    c = V.table(spark, sf_dir, "customer")
    line = F.concat(F.lit("| "), "c_name", F.lit(" | "), F.replace("c_mktsegment", F.lit("I"), F.lit("\\|")), F.lit(" |"))
    cells = c.select("c_custkey", C.split_row(line).alias("cells"))
    return cells.select("c_custkey", F.size("cells").alias("n_cells"), F.element_at("cells", 2).alias("second"))


_PARENT = """,, closed as (
        select a.doc, a.pos, a.id, a.type, a.level, a.md, max(b.pos) as up
        from doc_elements a left join doc_elements b on a.doc = b.doc and b.type = 'heading' and b.pos < a.pos and (a.type <> 'heading' or b.level < a.level)
        group by all
    ), parented as (select c.doc, c.pos, c.id, c.type, c.level, c.md, p.id as parent from closed c left join doc_elements p on c.doc = p.doc and c.up = p.pos)"""


@query(_PARENT + " select doc, pos, id, parent from parented", V.DOC_ELEMENTS)
def default_parent(spark, sf_dir):
    return structure.default_parent(V.doc_elements(spark, sf_dir)).select("doc", "pos", "id", "parent")


_TITLE = "trim(case when type = 'heading' then regexp_replace(md, '^#{1,6}\\s*', '') else string_split(md, chr(10))[1] end)"


@query(
    _PARENT
    + f""", walk as (
        select p.doc, p.id, p.parent as up, ''::varchar as path, 0 as depth from parented p
        union all
        select w.doc, w.id, p.parent, {_TITLE.replace("type", "p.type").replace("md", "p.md")} || case when w.depth > 0 then ' > ' || w.path else '' end, w.depth + 1
        from walk w join parented p on p.doc = w.doc and p.id = w.up
    ) select doc, id, arg_max(path, depth) as path, max(depth) as depth from walk group by doc, id""",
    "recursive " + V.DOC_ELEMENTS,
)
def heading_path(spark, sf_dir):
    paths = structure.ancestors(materialize(structure.default_parent(V.doc_elements(spark, sf_dir)), "parented"))
    return paths.select("doc", "id", F.array_join("path", " > ").alias("path"), F.size("path").alias("depth"))


@query("select doc, pos, repeat('  ', level - 1) || '- ' || regexp_replace(md, '^#{1,6}\\s*', '') as line from doc_elements where type = 'heading'", V.DOC_ELEMENTS)
def outline(spark, sf_dir):
    return structure.outline(V.doc_elements(spark, sf_dir))


@query("select doc, type, count(*) as elements, sum(characters)::bigint as characters from linked_elements group by doc, type", V.LINKED_ELEMENTS)
def info_counts(spark, sf_dir):
    return structure.type_counts(V.linked_elements(spark, sf_dir))


@query(
    """select doc, sha256(string_agg(type || chr(10) || md || chr(10), '' order by pos)) as sha256, count(*) as elements, bool_or(type = 'heading') as structure,
        max(regexp_extract(id, '#e([0-9]+)$', 1)::bigint) as last_id from doc_elements group by doc""",
    V.DOC_ELEMENTS,
)
def header_rollup(spark, sf_dir):
    from stratalith.operators.filling import header_rollup as rollup

    return rollup(V.doc_elements(spark, sf_dir))


@query("select id, array_to_string(coalesce(access, case when length(doc) % 2 = 0 then ['team'] end, ['all']), ',') as access from linked_elements", V.LINKED_ELEMENTS)
def access_inherit(spark, sf_dir):
    e = V.linked_elements(spark, sf_dir)
    headers = e.select("doc").distinct().select("doc", F.when(F.length("doc") % 2 == 0, F.array(F.lit("team"))).alias("access"))
    return chunking.with_header(e, headers).select("id", F.array_join("access", ",").alias("access"))


@query("select id from doc_elements e where pos >= coalesce((select min(pos) from doc_elements b where b.doc = e.doc and b.id = e.doc || '#e3'), pos)", V.DOC_ELEMENTS)
def body_cut(spark, sf_dir):
    return chunking.body_only(V.doc_elements(spark, sf_dir), F.concat("doc", F.lit("#e3"))).select("id")


@query("select id, type from linked_elements where type not in ('noise', 'toc', 'redaction')", V.LINKED_ELEMENTS)
def embeddable_elements(spark, sf_dir):
    return chunking.embeddable(V.linked_elements(spark, sf_dir)).select("id", "type")


_KEPT = """,, kept as (select * from linked_elements where type <> 'noise'),
    claims as (
        select e.doc, e.id, e.continues as up, row_number() over (partition by e.doc, e.continues order by e.pos) as n
        from kept e join kept p on p.doc = e.doc and p.id = e.continues and p.type = e.type and p.pos < e.pos
    ), chain as (
        select k.doc, k.id, k.id as root, 0 as step from kept k left join claims c on c.doc = k.doc and c.id = k.id and c.n = 1 where c.id is null
        union all
        select c.doc, c.id, h.root, h.step + 1 from claims c join chain h on h.doc = c.doc and h.id = c.up where c.n = 1
    )"""


@query(_KEPT + " select id, root from chain", "recursive " + V.LINKED_ELEMENTS)
def continues_chains(spark, sf_dir):
    return structure.continuation_roots(chunking.embeddable(_linked(spark, sf_dir))).select("id", "root")


_UNITS = (
    _KEPT
    + """, members as (select h.root, h.doc, k.* exclude (doc) from chain h join kept k on k.doc = h.doc and k.id = h.id),
    units as (
        select doc, root as id, min(pos) as pos, arg_min(type, pos) as type, string_agg(md, ' ' order by pos) as md, count(*) as parts, arg_min(reference, pos) as reference, arg_min(level, pos) as level,
               case when count(*) > 1 then substr(sha256(string_agg(hash, chr(10) order by pos)), 1, 16) else arg_min(hash, pos) end as hash, list(hash order by pos) as hashes, list(id order by pos) as ids,
               min(page) as first_page, max(page) as last_page
        from members group by doc, root
    )"""
)


_CUT_LINES = """cut_elements as (select * replace (case when type = 'paragraph' and length(md) % 2 = 0 then lower(regexp_replace(md, '[ .]*$', '')) || '-' when type = 'paragraph' then lower(md) else md end as md) from linked_elements)"""


@query(
    (_UNITS.replace("string_agg(md, ' ' order by pos)", "string_agg(md, chr(1) order by pos)").replace("linked_elements", "cut_elements"))
    + r""" select id, replace(regexp_replace(md, '([\p{L}\p{N}_])-\x01(\p{Ll})', '\1\2', 'g'), chr(1), ' ') as md, parts from units where parts > 1""",
    "recursive " + V.LINKED_ELEMENTS + ", " + _CUT_LINES,
)
def joined_md(spark, sf_dir):
    e = _linked(spark, sf_dir)
    cut = F.when(F.length("md") % 2 == 0, F.concat(F.lower(F.regexp_replace("md", "[ .]*$", "")), F.lit("-"))).otherwise(F.lower("md"))
    u = structure.joined_units(chunking.embeddable(e.withColumn("md", F.when(F.col("type") == "paragraph", cut).otherwise(F.col("md")))))
    return u.select("id", "md", F.size("part_ids").cast("long").alias("parts")).where("parts > 1")


@query(_UNITS + " select id, hash from units", "recursive " + V.LINKED_ELEMENTS)
def joined_hash(spark, sf_dir):
    return structure.joined_units(chunking.embeddable(_linked(spark, sf_dir))).select("id", "hash")


@query(_UNITS + " select id, case when first_page = last_page then first_page end as page, case when first_page < last_page then first_page end as first_page, case when first_page < last_page then last_page end as last_page from units", "recursive " + V.LINKED_ELEMENTS)
def joined_pages(spark, sf_dir):
    u = structure.joined_units(chunking.embeddable(_linked(spark, sf_dir)))
    return u.select("id", "page", F.col("pages")[0].alias("first_page"), F.col("pages")[1].alias("last_page"))


_TIED = _UNITS + """, ties as (
        select n.doc, n.id, t.id as target from units n join (select doc, id, unnest(ids) as part from units) t on t.doc = n.doc and t.part = n.reference where n.type in ('caption', 'footnote')
    )"""


@query(_TIED + " select id, target from ties", "recursive " + V.LINKED_ELEMENTS)
def attachments(spark, sf_dir):
    units = materialize(structure.joined_units(chunking.embeddable(_linked(spark, sf_dir))), "units")
    return chunking._attached(units).select("id", "target")


@query(_TIED + " select u.id from units u where u.type = 'caption' and u.reference is not null and u.id not in (select id from ties)", "recursive " + V.LINKED_ELEMENTS)
def orphan_attachments(spark, sf_dir):
    units = materialize(structure.joined_units(chunking.embeddable(_linked(spark, sf_dir))), "units")
    return units.where("type = 'caption' and reference is not null").join(chunking._attached(units), ["doc", "id"], "left_anti").select("id")


_CHUNKS = _TIED + """, gathered as (
        select u.doc, coalesce(t.target, u.id) as chunk, t.target is null as anchor, case when t.target is null then -1 else u.pos end as rank, u.*
        from units u left join ties t on t.doc = u.doc and t.id = u.id
    ), chunks as (
        select doc, chunk as id, sum(parts)::bigint as parts, case when sum(parts) > 1 then substr(sha256(string_agg(array_to_string(hashes, chr(10)), chr(10) order by rank)), 1, 16) else arg_min(hash, rank) end as hash,
               sum(length(md))::bigint as md_characters
        from gathered group by doc, chunk having bool_or(anchor)
    )"""


@query(_CHUNKS + " select id, parts, hash from chunks", "recursive " + V.LINKED_ELEMENTS)
def element_chunks(spark, sf_dir):
    e = structure.default_parent(V.linked_elements(spark, sf_dir))
    return chunking.element_chunks(e).select("id", F.coalesce(F.size("elements"), F.lit(1)).cast("long").alias("parts"), "hash").withColumn("parts", F.when(F.col("parts") < 1, 1).otherwise(F.col("parts")))


_SECTIONS = """,, marked as (
        select *, case when lag(id) over w is null or (type = 'heading' and not coalesce(lag(type) over w = 'heading' and lag(level) over w < level, false)) then 1 else 0 end as b
        from doc_elements window w as (partition by doc order by pos)
    ), sectioned as (select *, sum(b) over (partition by doc order by pos rows unbounded preceding) as section from marked)"""


@query(
    _SECTIONS
    + """ select doc, arg_min(id, pos) as id, count(*) as parts, substr(sha256(string_agg(hash, chr(10) order by pos)), 1, 16) as hash, sum(length(md))::bigint + 2 * (count(*) - 1) as md_characters,
        case when min(page) = max(page) then min(page) end as page from sectioned group by doc, section""",
    V.DOC_ELEMENTS,
)
def section_chunks(spark, sf_dir):
    e = structure.default_parent(V.doc_elements(spark, sf_dir)).withColumn("continues", F.lit(None).cast("string"))
    c = chunking.section_chunks(e)
    return c.select("doc", "id", F.size("elements").cast("long").alias("parts"), "hash", F.length("md").cast("long").alias("md_characters"), "page")


@query(
    _SECTIONS
    + """, numbered as (select *, row_number() over (partition by doc, section order by pos) as k, length(md) as n from sectioned),
    packing as (
        select doc, section, k, pos, id, hash, 1 as part, n::bigint as size, type = 'heading' as only_head from numbered where k = 1
        union all
        select x.doc, x.section, x.k, x.pos, x.id, x.hash, case when p.size + x.n > 400 and not p.only_head then p.part + 1 else p.part end,
               case when p.size + x.n > 400 and not p.only_head then x.n else p.size + x.n end, false
        from packing p join numbered x on x.doc = p.doc and x.section = p.section and x.k = p.k + 1
    ), whole as (select doc, section, max(part) as parts, min(case when k = 1 and only_head then id end) as head from packing group by doc, section)
    select coalesce(w.head, arg_min(p.id, p.pos)) || case when w.parts > 1 then '/' || p.part else '' end as id, count(*) as members, substr(sha256(string_agg(p.hash, chr(10) order by p.pos)), 1, 16) as hash
    from packing p join whole w on w.doc = p.doc and w.section = p.section group by p.doc, p.section, p.part, w.parts, w.head""",
    "recursive " + V.DOC_ELEMENTS,
)
def section_chunks_split(spark, sf_dir):
    e = structure.default_parent(V.doc_elements(spark, sf_dir)).withColumn("continues", F.lit(None).cast("string"))
    return chunking.section_chunks(e, max_chars=400).select("id", F.size("elements").cast("long").alias("members"), "hash")


@query(
    _PARENT
    + f""" select c.id, case when c.parent is null then c.md else (select string_agg(t, ' > ' order by pos) from (
        select {_TITLE} as t, pos from parented a where a.doc = c.doc and a.type = 'heading' and a.pos < c.pos
            and a.level < case when c.type = 'heading' then c.level else 7 end
            and not exists (select 1 from parented z where z.doc = c.doc and z.type = 'heading' and z.pos > a.pos and z.pos < c.pos and z.level <= a.level))) || chr(10) || chr(10) || c.md end as text
    from parented c""",
    V.DOC_ELEMENTS,
)
def chunk_text(spark, sf_dir):
    e = materialize(structure.default_parent(V.doc_elements(spark, sf_dir)), "parented")
    paths = structure.ancestors(e)
    return e.join(paths, ["doc", "id"]).select("id", chunking.chunk_text(F.col("path"), F.col("md")).alias("text"))


_OLD = """,, old as (select id, pos, md, case when length(md) % 7 = 0 then 'x' || hash else hash end as hash from doc_elements where length(md) % 10 <> 3),
    new as (select id, pos, md, hash from doc_elements where length(md) % 10 <> 4)"""


def _versions(spark, sf_dir):
    e = V.doc_elements(spark, sf_dir)
    n = F.length("md")
    old = e.where(n % 10 != 3).select("id", "pos", "md", F.when(n % 7 == 0, F.concat(F.lit("x"), "hash")).otherwise(F.col("hash")).alias("hash"))
    return e.where(n % 10 != 4).select("id", "pos", "md", "hash"), old


@query(_OLD + " select n.id, n.hash from new n left join old o on o.id = n.id where o.id is null or o.hash <> n.hash", V.DOC_ELEMENTS)
def changed_chunks(spark, sf_dir):
    new, old = _versions(spark, sf_dir)
    return chunking.changed_chunks(new, old).select("id", "hash")


@query(_OLD + " select id from old where id not in (select id from new)", V.DOC_ELEMENTS)
def removed_chunks(spark, sf_dir):
    new, old = _versions(spark, sf_dir)
    return chunking.removed_chunks(new, old).select("id")


@query(_OLD + " select count(*) as to_embed from (select distinct md from new except select distinct md from old)", V.DOC_ELEMENTS)
def reembed_count(spark, sf_dir):
    return chunking.reembed_count(*_versions(spark, sf_dir))


@query(
    """select doc_id, w as "window", substr(text, (w * 1000 + 1)::int, 1000) as piece from (select doc_id, text, unnest(range((length(text) + 999) // 1000)) as w from documents)"""
)
def fixed_windows(spark, sf_dir):
    out = chunking.fixed_windows(V.table(spark, sf_dir, "documents").select("doc_id", "text"), "text", 1000)
    return out.withColumn("window", F.col("window").cast("long"))


_STOP = "(" + ", ".join(f"'{w}'" for w in retrieval.STOP_WORDS) + ")"
_TERMS = f"""terms as (
        select doc_id as id, term, count(*) as tf from (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from documents) where term not in {_STOP} group by all
    ), idf as (
        select term, count(*) as df, ln(((select count(*) from documents) + 1.0::double) / (count(*) + 1.0::double)) + 1.0::double as idf from terms group by term
    ), weighed as (
        select id, t.term, (1 + ln(tf)) * idf as w from terms t join idf i on i.term = t.term
    ), norms as (select id, sqrt(sum(w * w)) as norm from weighed group by id)"""


def _chunks(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("staff"))).otherwise(F.array(F.lit("all"))).alias("access"))


@query("select id, term, tf from terms", _TERMS)
def tokens(spark, sf_dir):
    return retrieval.term_counts(_chunks(spark, sf_dir), "id", "text")


@query("select term, df, round(idf, 6) as idf from idf", _TERMS)
def doc_freq_idf(spark, sf_dir):
    c = _chunks(spark, sf_dir)
    return retrieval.inverse_frequency(retrieval.term_counts(c, "id", "text"), "id", c.count()).select("term", "df", F.round("idf", 6).alias("idf"))


@query("select id, round(norm, 6) as norm from norms", _TERMS)
def tfidf_norm(spark, sf_dir):
    c = _chunks(spark, sf_dir)
    counts = retrieval.term_counts(c, "id", "text")
    w = retrieval.weights(counts, retrieval.inverse_frequency(counts, "id", c.count()), "id")
    return w.groupBy("id").agg(F.round(F.first("norm"), 6).alias("norm"))


def _hits(condition: str) -> str:
    return f""",, q as (
        select item_id, term, count(*) as tf from (select item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from benchmark) where term not in {_STOP} group by all
    ), qw as (select item_id, q.term, (1 + ln(tf)) * coalesce(idf, 1.0) as w from q left join idf on idf.term = q.term),
    qn as (select item_id, sqrt(sum(w * w)) as norm from qw group by item_id),
    scores as (
        select qw.item_id, d.id, round(sum(d.w / n.norm * qw.w / qn.norm), 9) as score
        from qw join qn on qn.item_id = qw.item_id join weighed d on d.term = qw.term join norms n on n.id = d.id {condition} group by all
    ), hits as (select *, row_number() over (partition by item_id order by score desc, id) as rank from scores where score > 0 qualify rank <= 5)"""


def _search(spark, sf_dir, allowed=None):
    index = retrieval.TfidfIndex(_chunks(spark, sf_dir), access="access")
    return index.search(V.table(spark, sf_dir, "benchmark"), "item_id", "text", top=5, allowed=allowed)


@query(_hits("") + " select item_id, id, round(score, 6) as score, rank from hits", _TERMS)
def tfidf_search(spark, sf_dir):
    return _search(spark, sf_dir).select("item_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(_hits("where d.id % 3 <> 0") + " select item_id, id, round(score, 6) as score, rank from hits", _TERMS)
def tfidf_search_access(spark, sf_dir):
    return _search(spark, sf_dir, ("all",)).select("item_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(_hits("") + """ select count(*) as questions, count(h) as hits from (select b.item_id, max(case when contains(d.text, b.text) then 1 end) as h
    from benchmark b left join hits x on x.item_id = b.item_id left join documents d on d.doc_id = x.id group by b.item_id)""", _TERMS)
def hit_at_5(spark, sf_dir):
    answers = V.table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("answer"))
    return retrieval.hit_rate(_search(spark, sf_dir), _chunks(spark, sf_dir), answers, "item_id")


@query(
    """select * from (select q.vec_id as query, v.vec_id, round(list_dot_product(q.embedding::double[], v.embedding::double[]) / sqrt(list_dot_product(q.embedding::double[], q.embedding::double[])) / sqrt(list_dot_product(v.embedding::double[], v.embedding::double[])), 6) as score,
        row_number() over (partition by q.vec_id order by round(list_dot_product(q.embedding::double[], v.embedding::double[]) / sqrt(list_dot_product(q.embedding::double[], q.embedding::double[])) / sqrt(list_dot_product(v.embedding::double[], v.embedding::double[])), 9) desc, v.vec_id) as rank
        from embeddings q, embeddings v where q.vec_id % 20 = 0 and q.vec_id <> v.vec_id) where rank <= 5"""
)
def embedding_topk(spark, sf_dir):
    e = V.table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    out = retrieval.nearest_vectors(e, e.where("vec_id % 20 = 0"), "vec_id", "embedding", 5)
    return out.select("query", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def _rule(rule_sql: str):
    return query(rule_sql, V.LINKED_ELEMENTS)


@_rule("select doc, pos, 'duplicate_label' as rule, 'label ' || label || ' is used twice' as message from linked_elements where label is not null qualify row_number() over (partition by doc, label order by pos) > 1")
def check_duplicate_labels(spark, sf_dir):
    return constraints.duplicates(V.linked_elements(spark, sf_dir), "label")


@_rule(",, twice as (select doc, pos, doc || '#e' || (1 + pos // 2) as id from linked_elements) select doc, pos, 'duplicate_id' as rule, 'id ' || id || ' is used twice' as message from twice qualify row_number() over (partition by doc, id order by pos) > 1")
def check_duplicate_ids(spark, sf_dir):
    twice = V.linked_elements(spark, sf_dir).select("doc", "pos", F.concat("doc", F.lit("#e"), (F.floor(F.col("pos") / 2) + 1).cast("string")).alias("id"))
    return constraints.duplicates(twice, "id")


@_rule("select e.doc, e.pos, 'reference' as rule, 'reference ' || reference || ' does not exist' as message from linked_elements e where reference is not null and not exists (select 1 from linked_elements t where t.doc = e.doc and t.id = e.reference)")
def check_reference(spark, sf_dir):
    return constraints.references(V.linked_elements(spark, sf_dir))


@_rule(
    """select e.doc, e.pos, 'continues' as rule, case when t.id is null or t.pos >= e.pos then 'continues must point to an earlier element' else 'continues must point to an element of the same type' end as message
    from linked_elements e left join linked_elements t on t.doc = e.doc and t.id = e.continues where e.continues is not null and (t.id is null or t.pos >= e.pos or t.type <> e.type)"""
)
def check_continues(spark, sf_dir):
    return constraints.continuations(V.linked_elements(spark, sf_dir))


_WILD = """,, wild as (select doc, pos, id, type, level, case when length(md) % 9 = 0 then doc || '#e77777' when length(md) % 9 = 1 then lead(id) over w when length(md) % 9 = 2 then lag(id) over w end as parent
        from doc_elements window w as (partition by doc order by pos))"""


@query(
    _WILD
    + """ select e.doc, e.pos, 'parent' as rule, case when t.id is null then 'parent ' || e.parent || ' does not exist' when t.pos >= e.pos then 'parent must come before the element'
        when t.type not in ('heading', 'group') then 'parent must be a heading or a group' else 'a heading''s parent must be a heading with a smaller level' end as message
    from wild e left join wild t on t.doc = e.doc and t.id = e.parent
    where e.parent is not null and (t.id is null or t.pos >= e.pos or t.type not in ('heading', 'group') or (e.type = 'heading' and t.type = 'heading' and t.level >= e.level))""",
    V.DOC_ELEMENTS,
)
def check_parent(spark, sf_dir):
    n, wd = F.length("md"), structure.reading_order()
    e = V.doc_elements(spark, sf_dir)
    parent = F.when(n % 9 == 0, F.concat("doc", F.lit("#e77777"))).when(n % 9 == 1, F.lead("id").over(wd)).when(n % 9 == 2, F.lag("id").over(wd))
    return constraints.parents(e.withColumn("parent", parent))


_LOOSE = """,, loose as (select doc, pos, type, hash, characters, case when type = 'heading' and length(md) % 2 = 0 then md || ' ##' when length(md) % 3 = 0 then md || '  ' else md end as md from linked_elements),
    tidy as (select *, case when type = 'heading' then regexp_extract(md, '^(#+)', 1) || rtrim(' ' || trim(regexp_replace(regexp_extract(md, '^#+\\s*(.*)$', 1), '(^|\\s)#+$', ''))) when md like '%  ' then rtrim(md) || chr(92) else rtrim(md) end as good from loose)"""


@_rule(
    _LOOSE
    + """ select doc, pos, 'hash' as rule, 'hash is wrong' as message from tidy where hash <> substr(sha256(type || chr(10) || md), 1, 16)
        union all select doc, pos, 'characters', 'characters should be ' || length(md) from tidy where characters <> length(md)
        union all select doc, pos, 'canonical', 'md is not canonical' from tidy where md <> good"""
)
def check_hash(spark, sf_dir):
    n = F.length("md")
    loose = F.when((F.col("type") == "heading") & (n % 2 == 0), F.concat("md", F.lit(" ##"))).when(n % 3 == 0, F.concat("md", F.lit("  "))).otherwise(F.col("md"))
    return constraints.stored_text(V.linked_elements(spark, sf_dir).withColumn("md", loose))


_FIELDS = """,, wild as (
        select doc, pos, case when n % 7 = 0 then 'other#e' || (pos + 1) else id end as id, type, md, case when n % 29 = 0 then 'above' when n % 31 = 0 then 'below' else label end as label,
            case when type = 'heading' and n % 4 <> 0 then level when n % 37 = 0 then 3 end as level,
            case when n % 5 = 0 then null else page end as page, case when n % 41 = 0 then [page, page + 1] end as pages, case when n % 6 = 0 then [n, 2, 3, case when n % 12 = 0 then 1200 else 4 end] end as bbox,
            case when n % 43 = 0 then [1, 2] when n % 47 = 0 then [1] end as n_refs, case when n % 8 = 0 then '# ' || md else md end as raw, n
        from (select *, length(md) as n from linked_elements))"""


def _wild(spark, sf_dir):
    """Elements with fields that break rules, by the lengths of their texts."""
    e, n = V.linked_elements(spark, sf_dir), F.length("md")
    label = F.when(n % 29 == 0, "above").when(n % 31 == 0, "below").otherwise(F.col("label"))
    rows = e.withColumn("bbox", F.when(n % 6 == 0, F.array(n, F.lit(2), F.lit(3), F.when(n % 12 == 0, 1200).otherwise(4)))).withColumn("pages", F.when(n % 41 == 0, F.array("page", F.col("page") + 1)))
    rows = rows.withColumn("level", F.when((F.col("type") == "heading") & (n % 4 != 0), F.col("level")).when(n % 37 == 0, 3)).withColumn("page", F.when(n % 5 != 0, F.col("page")))
    return rows.withColumn("id", F.when(n % 7 == 0, F.concat(F.lit("other#e"), F.col("pos") + 1)).otherwise(F.col("id"))).withColumn("label", label)


@_rule(
    _FIELDS
    + """ select doc, pos, 'companion' as rule, message from (
        select doc, pos, unnest(list_filter([
            case when bbox is not null and page is null then 'bbox is allowed only together with page' end, case when page is not null and pages is not null then 'page and pages exclude each other' end,
            case when type = 'heading' and level is null then 'a heading needs a level' end, case when type = 'noise' then 'noise needs a subtype' end, case when type <> 'heading' and level is not null then 'level is only for headings' end
        ], lambda m: m is not null)) as message from wild)"""
)
def check_companions(spark, sf_dir):
    return constraints.field_companions(_wild(spark, sf_dir))


@_rule(
    _FIELDS
    + """ select doc, pos, 'pattern' as rule, 'bbox has not the form of its field' as message from wild where bbox is not null and (bbox[1] > 1000 or bbox[4] > 1000)
        union all select doc, pos, 'pattern', 'level has not the form of its field' from wild where level not between 1 and 6"""
)
def check_places(spark, sf_dir):
    return constraints.field_patterns(_wild(spark, sf_dir).select("doc", "pos", "bbox", "level", "page"))


@_rule(_FIELDS + " select doc, pos, 'prefix' as rule, 'id must start with ' || doc || '#' as message from wild where not starts_with(id, doc || '#')")
def check_prefix(spark, sf_dir):
    return constraints.id_prefix(_wild(spark, sf_dir))


@_rule(_FIELDS + " select doc, pos, 'reserved' as rule, 'label ' || label || ' is a reserved word' as message from wild where label in ('above', 'below')")
def check_reserved_labels(spark, sf_dir):
    return constraints.reserved_labels(_wild(spark, sf_dir))


@_rule(_FIELDS + " select doc, pos, 'reference_list' as rule, 'a single reference must be a string' as message from wild where len(n_refs) = 1")
def check_reference_list(spark, sf_dir):
    n = F.length("md")
    refs = F.when(n % 43 == 0, F.array(F.lit("a"), F.lit("b"))).when(n % 47 == 0, F.array(F.lit("a")))
    return constraints.single_reference_list(V.linked_elements(spark, sf_dir).withColumn("reference", refs).withColumn("reference_is_list", refs.isNotNull()))


@_rule(
    """,, marked as (select doc, pos, level, case when length(md) % 3 = 0 then '#' || md else md end as md from linked_elements where type = 'heading')
    select doc, pos, 'level' as rule, 'level does not match the marks' as message from marked where length(regexp_extract(md, '^(#{1,6})([ \\t]|$|\\n)', 1)) <> level"""
)
def check_heading_marks(spark, sf_dir):
    e = V.linked_elements(spark, sf_dir).where("type = 'heading'")
    return constraints.heading_level(e.withColumn("md", F.when(F.length("md") % 3 == 0, F.concat(F.lit("#"), "md")).otherwise(F.col("md"))))


@query(
    """with heads as (select 'd' || doc_id as doc, lang, case when length(text) % 5 = 0 then 'Version 1' else '1.1' end as version, case when length(text) % 3 = 0 then 'D' || doc_id else 'd' || doc_id end as name,
            case when length(text) % 4 = 0 then '2024-01-01 00:00' else '2024-01-01T00:00:00Z' end as created, case when length(text) % 6 = 0 then 'yesterday' else '2024-01' end as date, case when length(text) % 7 = 0 then 'secret' else 'none' end as protection
        from documents where text is not null)
    select name as doc, 0 as pos, 'header' as rule, unnest(list_filter([
        case when not regexp_matches(version, '^[0-9]+\\.[0-9]+$') then 'version has not the form of its field' end, case when not regexp_matches(name, '^[a-z0-9_-]+$') then 'doc has not the form of its field' end,
        case when created like '% %' then 'created has not the form of its field' end, case when date = 'yesterday' then 'date has not the form of its field' end,
        case when protection = 'secret' then 'protection is none of its values' end], lambda m: m is not null)) as message from heads"""
)
def check_headers(spark, sf_dir):
    d, n = V.table(spark, sf_dir, "documents").where("text is not null"), F.length("text")
    either = lambda k, bad, good: F.when(n % k == 0, bad).otherwise(good)
    name = F.concat(either(3, F.lit("D"), F.lit("d")), "doc_id")
    heads = d.select(name.alias("doc"), "lang", either(5, "Version 1", "1.1").alias("version"), either(4, "2024-01-01 00:00", "2024-01-01T00:00:00Z").alias("created"), either(6, "yesterday", "2024-01").alias("date"), either(7, "secret", "none").alias("protection"))
    return constraints.header_rules(heads)


_TEXT_LINKS = ",, linked_text as (select doc, pos, type, id, label, md || ' [see](#e' || (length(md) % 40) || ') `[code](#nowhere)` [l](#l' || (length(md) % 50) || ')' as md from linked_elements)"


@_rule(
    _TEXT_LINKS
    + r""" select x.doc, x.pos, 'link' as rule, 'link to #' || target || ' points to no element or label' as message
    from (select doc, pos, unnest(regexp_extract_all(regexp_replace(md, '`[^`]*`', '', 'g'), '\]\(#([a-z0-9_-]+)\)', 1)) as target from linked_text) x
    where not exists (select 1 from linked_text t where t.doc = x.doc and (t.id = x.doc || '#' || target or t.label = target))"""
)
def check_links(spark, sf_dir):
    n = F.length("md")
    md = F.concat("md", F.lit(" [see](#e"), (n % 40).cast("string"), F.lit(") `[code](#nowhere)` [l](#l"), (n % 50).cast("string"), F.lit(")"))
    return constraints.links(V.linked_elements(spark, sf_dir).withColumn("md", md))


_HEADERS = ",, headers as (select doc, case when count(*) % 5 = 0 then null when count(*) % 5 = 1 then count(*) + 1 else count(*) end as says, count(*) as has from linked_elements group by doc)"


def _headers(e: DataFrame) -> DataFrame:
    n = F.count("*")
    return e.groupBy("doc").agg(F.when(n % 5 == 0, F.lit(None)).when(n % 5 == 1, n + 1).otherwise(n).alias("elements"), (F.max(C.id_number(F.col("id"))) - 2).alias("last_id"))


@_rule(
    _HEADERS
    + """ select doc, 0 as pos, 'count' as rule, case when says is null then 'elements is null: the file is not finished' else 'elements says ' || says || ' but the file has ' || has end as message
    from headers where says is null or says <> has"""
)
def check_count(spark, sf_dir):
    e = V.linked_elements(spark, sf_dir)
    return constraints.element_count(e, _headers(e))


@_rule(
    ",, tops as (select doc, max(regexp_extract(id, '#e([0-9]+)$', 1)::bigint) - 2 as last_id from linked_elements group by doc)"
    " select e.doc, e.pos, 'last_id' as rule, 'id number is higher than last_id in the header' as message from linked_elements e join tops t on t.doc = e.doc where regexp_extract(e.id, '#e([0-9]+)$', 1)::bigint > t.last_id"
)
def check_last_id(spark, sf_dir):
    e = V.linked_elements(spark, sf_dir)
    return constraints.id_beyond_last(e, _headers(e))


@_rule(
    """select doc, pos, rule, message from (
        select doc, pos, 'pattern' as rule, 'label has not the form of its field' as message from linked_elements where length(md) % 17 = 0 and length(md) % 3 = 0
        union all select doc, pos, 'pattern', 'level has not the form of its field' from linked_elements where type = 'heading' and length(md) % 3 = 0)"""
)
def check_patterns(spark, sf_dir):
    n = F.length("md")
    e = V.linked_elements(spark, sf_dir).withColumn("label", F.when(n % 3 == 0, F.concat(F.lit("9"), "label")).otherwise(F.col("label"))).withColumn("level", F.when(n % 3 == 0, F.col("level") + 6).otherwise(F.col("level")))
    return constraints.field_patterns(e)


@_rule(
    """select doc, pos, 'required' as rule, 'missing ''' || k || '''' as message from (
        select doc, pos, unnest(list_filter(['id', 'hash', 'type', 'parent', 'characters', 'md'], lambda k: k = 'parent' or (k = 'hash' and length(md) % 4 = 0))) as k from linked_elements)"""
)
def check_required(spark, sf_dir):
    keys = F.when(F.length("md") % 4 == 0, F.array(*map(F.lit, ("id", "type", "characters", "md", "more")))).otherwise(F.array(*map(F.lit, ("id", "hash", "type", "characters", "md"))))
    return constraints.missing_fields(V.linked_elements(spark, sf_dir).withColumn("keys", keys), constraints.ELEMENT_REQUIRED)


@_rule(
    """select rule, count(*) as violations, count(distinct doc) as documents from (
        select distinct doc, pos, rule, message from (
            select doc, pos, 'duplicate_label' as rule, label as message from linked_elements where label is not null qualify row_number() over (partition by doc, label order by pos) > 1
            union all select e.doc, e.pos, 'reference', reference from linked_elements e where reference is not null and not exists (select 1 from linked_elements t where t.doc = e.doc and t.id = e.reference)
            union all select e.doc, e.pos, 'continues', e.continues from linked_elements e left join linked_elements t on t.doc = e.doc and t.id = e.continues where e.continues is not null and (t.id is null or t.pos >= e.pos or t.type <> e.type)
            union all select doc, pos, 'hash', hash from linked_elements where hash <> substr(sha256(type || chr(10) || md), 1, 16))) group by rule"""
)
def violations_report(spark, sf_dir):
    e = _linked(spark, sf_dir)
    rules = (constraints.duplicates(e, "label"), constraints.references(e), constraints.continuations(e), constraints.stored_text(e).where("rule = 'hash'"))
    every = rules[0]
    for r in rules[1:]:
        every = every.unionByName(r)
    return every.distinct().groupBy("rule").agg(F.count("*").alias("violations"), F.count_distinct("doc").alias("documents"))


_WORDS = r"""regexp_extract_all(lower(replace({0}, '-', '')), '\p{{L}}+(?:[''’]\p{{L}}+)?')"""
_OUT = f"""source_words as (
        select 'd' || doc_id as doc, word, count(*) as n from (select doc_id, unnest({_WORDS.format("text")}) as word from documents) group by all
    ), output_words as (
        select 'd' || doc_id as doc, word, count(*) as n from (select doc_id, unnest({_WORDS.format("replace(text, ', ', ',')")}) as word from documents where length(text) % 4 <> 0) group by all
    )"""


def _both(spark, sf_dir):
    """Word counts of the documents, and of what an import kept of them: it lost some texts, and blanks behind commas."""
    docs = V.table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("doc"), "text")
    out = docs.where(F.length("text") % 4 != 0).select("doc", F.replace("text", F.lit(", "), F.lit(",")).alias("text"))
    return quality.word_counts(docs, "text"), quality.word_counts(out, "text")


@query(
    """,, lost as (
        select s.doc, s.word, s.n - coalesce(o.n, 0) as lost from source_words s left join output_words o on o.doc = s.doc and o.word = s.word where s.n > coalesce(o.n, 0)
    ), cuts as (
        select doc, word, substr(word, 1, k::int) as a, substr(word, k::int + 1) as b from (select doc, word, unnest(range(1, length(word))) as k from lost)
    ), explained as (
        select distinct c.doc, c.word from cuts c join output_words x on x.doc = c.doc and x.word = c.a join output_words y on y.doc = c.doc and y.word = c.b
    )
    select l.doc, l.word, l.lost from lost l left join explained e on e.doc = l.doc and e.word = l.word where e.doc is null""",
    _OUT,
)
def words_lost(spark, sf_dir):
    return quality.words_lost(*_both(spark, sf_dir))


_PAIRS = f""",, seq as (select doc, pos, unnest(range(len(w))) as k, unnest(w) as a from (select doc, pos, {_WORDS.format("md")} as w from doc_elements)),
    pairs as (select doc, a, b, count(*) as n from (select doc, a, lead(a) over (partition by doc order by pos, k) as b from seq) where b is not null group by all)"""


@query(_PAIRS + " select doc, a, b, n from pairs", V.DOC_ELEMENTS)
def bigrams(spark, sf_dir):
    return quality.bigrams(V.doc_elements(spark, sf_dir))


@query(
    _PAIRS
    + """, counts as (select doc, a as word, count(*) as n from seq group by all),
    cuts as (select doc, word, unnest(range(2, length(word) - 1)) as k from counts where n <= 2 and length(word) >= 5)
    select c.doc, c.word, arg_min(substr(c.word, 1, c.k::int), c.k) as a, arg_min(substr(c.word, c.k::int + 1), c.k) as b
    from cuts c join counts x on x.doc = c.doc and x.word = substr(c.word, 1, c.k::int) and x.n >= 3 join counts y on y.doc = c.doc and y.word = substr(c.word, c.k::int + 1) and y.n >= 3
        join pairs p on p.doc = c.doc and p.a = x.word and p.b = y.word and p.n >= 1 group by c.doc, c.word""",
    V.DOC_ELEMENTS,
)
def glued_words(spark, sf_dir):
    return quality.glued_words(V.doc_elements(spark, sf_dir), frequent=3, together=1)


@query(
    """,, running as (select doc, page, case when length(md) % 3 = 0 then 'Part ' || chr((97 + length(md) % 7)::int) || ' - ' || page else md end as md from doc_elements where type = 'paragraph')
    select doc, key, count(distinct page) as pages from (select doc, regexp_replace(lower(md), '[^a-z]+', '', 'g') as key, page from running where length(md) < 80) where key <> '' group by all having count(distinct page) >= 3""",
    V.DOC_ELEMENTS,
)
def repeated_lines(spark, sf_dir):
    n = F.length("md")
    running = F.when(n % 3 == 0, F.concat(F.lit("Part "), F.chr(n % 7 + 97), F.lit(" - "), F.col("page").cast("string"))).otherwise(F.col("md"))
    return quality.repeated_lines(V.doc_elements(spark, sf_dir).withColumn("md", running))


@query("select doc, id, len(list_filter(regexp_split_to_array(md, '\\s+'), lambda w: w <> '')) as n_words from page_elements where type = 'paragraph' and len(list_filter(regexp_split_to_array(md, '\\s+'), lambda w: w <> '')) <= 2", V.PAGE_ELEMENTS)
def short_fragments(spark, sf_dir):
    return quality.short_fragments(V.page_elements(spark, sf_dir)).withColumn("n_words", F.col("n_words").cast("long"))


_CUT = """,, lowered as (select * replace (case when type = 'paragraph' then regexp_replace(lower(md), '[.]$', '') else md end as md) from doc_elements),
    ahead as (select *, lead(id) over w as next_id, lead(type) over w as next_type, lead(md) over w as next_md, lead(page) over w as next_page from lowered window w as (partition by doc order by pos))"""


def _lowered(spark, sf_dir):
    return V.doc_elements(spark, sf_dir).withColumn("md", F.when(F.col("type") == "paragraph", F.regexp_replace(F.lower("md"), "[.]$", "")).otherwise(F.col("md")))


@query(_CUT + """ select doc, id, next_id from ahead where type = 'paragraph' and next_type = 'paragraph' and page = next_page and not regexp_matches(regexp_replace(md, '\\s+$', ''), '[.!?:;"”’)\\]—…]$') and regexp_matches(next_md, '^\\p{Ll}')""", V.DOC_ELEMENTS)
def split_mid_sentence(spark, sf_dir):
    return quality.split_mid_sentence(_lowered(spark, sf_dir))


@query(_CUT + """ select doc, id, next_id from ahead where type = 'paragraph' and next_type = 'paragraph' and next_page = page + 1 and not regexp_matches(regexp_replace(md, '\\s+$', ''), '[.!?:;"”’)\\]—…]$') and regexp_matches(next_md, '^\\p{Ll}')""", V.DOC_ELEMENTS)
def page_break_cuts(spark, sf_dir):
    return quality.page_break_cuts(_lowered(spark, sf_dir))


@query("select doc, id from doc_elements where type = 'heading' and (length(regexp_replace(md, '^#+\\s*', '')) < 3 or length(md) > 120 or regexp_matches(md, '[a-z][.,;]$'))", V.DOC_ELEMENTS)
def odd_headings(spark, sf_dir):
    return quality.odd_headings(V.doc_elements(spark, sf_dir))


@query(
    """,, counts as (select doc, parent, count(*) as children from (select doc, page, case when length(md) % 3 = 0 then doc || '#e' || (length(md) % 4 + 1) else doc || '#e1' end as parent from doc_elements) group by all),
    whole as (select doc, count(*) as elements, count(distinct page) as pages from doc_elements group by doc),
    top as (select * from counts qualify row_number() over (partition by doc order by children desc, parent nulls first) = 1)
    select t.doc, t.parent, t.children, w.elements from top t join whole w on w.doc = t.doc where w.pages > 2 and t.children > w.elements * 0.5""",
    V.DOC_ELEMENTS,
)
def flat_structure(spark, sf_dir):
    n = F.length("md")
    e = V.doc_elements(spark, sf_dir).withColumn("parent", F.when(n % 3 == 0, F.concat("doc", F.lit("#e"), (n % 4 + 1).cast("string"))).otherwise(F.concat("doc", F.lit("#e1"))))
    return quality.flat_structure(e, least_pages=2)


@query(
    """,, heads as (select doc, pos, id, (1 + length(md) % 6)::int as level, row_number() over (partition by doc order by pos) as k from doc_elements where type = 'heading'),
    fold as (
        select doc, pos, id, level, k, 1 as clamped from heads where k = 1
        union all
        select h.doc, h.pos, h.id, h.level, h.k, least(h.level, f.clamped + 1)::int from fold f join heads h on h.doc = f.doc and h.k = f.k + 1
    ) select doc, pos, id, level, clamped from fold""",
    "recursive " + V.DOC_ELEMENTS,
)
def level_clamp(spark, sf_dir):
    heads = V.doc_elements(spark, sf_dir).where("type = 'heading'").select("doc", "pos", "id", (F.length("md") % 6 + 1).alias("level"))
    return structure.clamped_levels(heads)


@query("select doc, 'element ' || id as what, doc || ', page ' || (page + 1) || ', ' || split_part(id, '#', 2) as citation from doc_elements", V.DOC_ELEMENTS)
def citations(spark, sf_dir):
    e = V.doc_elements(spark, sf_dir)
    return e.select("doc", F.concat(F.lit("element "), "id").alias("what"), C.citation(F.col("doc"), F.col("page"), F.col("id")).alias("citation"))


@query("select p_partkey, regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9_-]+', '_', 'g') as slug, trim(regexp_replace(p_name || '  ' || p_brand, '\\s+', ' ', 'g')) as collapsed, replace(replace(replace(p_name || ' <&> ' || p_brand, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') as escaped from part")
def text_helpers(spark, sf_dir):
    p = V.table(spark, sf_dir, "part")
    return p.select(
        "p_partkey",
        C.slug(F.concat("p_name", F.lit(" "), "p_type")).alias("slug"),
        C.collapse(F.concat("p_name", F.lit("  "), "p_brand")).alias("collapsed"),
        C.escape_html(F.concat("p_name", F.lit(" <&> "), "p_brand")).alias("escaped"),
    )

