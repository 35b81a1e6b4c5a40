"""Queries of entities, structure, search and roll-ups in texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillframe.functions import rules
from quillframe.functions.spans import resolve, snippets, spans
from quillframe.functions.text import clean_ocr, mask_ssn, readable_lines, safe_name
from quillframe.operators import entities as E
from quillframe.operators import search as K
from quillframe.operators import structure as X
from quillframe.sources import writers
from quillframe.spread import spread

from .registry import FRAMES, frames, query, table

RULE = dict(rules.ENTITY_PATTERNS)
EMAIL = RULE["email"]


def span_sql(source: str, key: str, text: str, pattern: str) -> str:
    """Spans in SQL: lengths of gaps and matches added up."""
    p = pattern.replace("'", "''")
    return f"""with m as (select {key}, regexp_extract_all({text}, '{p}') as hits, string_split_regex({text}, '{p}') as gaps from {source}),
        n as (select {key}, hits, gaps, unnest(range(len(hits))) as i from m)
        select {key}, hits[i + 1] as value, cast(coalesce(list_sum(list_transform(gaps[1:i + 1], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(hits[1:i], lambda x: length(x))), 0) as int) as start from n"""


def _spans(df: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    return df.filter(F.col(text).rlike(pattern)).select(key, F.explode(spans(F.col(text), pattern)).alias("s")).select(key, F.col("s.text").alias("value"), F.col("s.start").alias("start"))


def _masked(source: str, key: str) -> str:
    """The source with a column in which letters beyond ASCII are underscores: as in Java, a word ends at neither of them."""
    return f"(select {key}, text, regexp_replace(text, '[ªµºÀ-ÖØ-öø-ɏͰ-ϿЀ-ӿ]', '_', 'g') as masked from {source})"


@query(span_sql("documents", "doc_id", "text", EMAIL))
def e2_email_spans(spark: SparkSession, d: str) -> DataFrame:
    return _spans(table(spark, d, "documents"), "doc_id", "text", EMAIL)


@query(span_sql("(select page_id, html || ' ' || url || ', ' || url as html from pages)", "page_id", "html", RULE["url"]))
def e2_url_spans(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", F.concat("html", F.lit(" "), "url", F.lit(", "), "url").alias("html"))
    return _spans(p, "page_id", "html", RULE["url"])


@query(span_sql("documents", "doc_id", "text", RULE["percentage"]))
def e3_percentage_spans(spark: SparkSession, d: str) -> DataFrame:
    return _spans(table(spark, d, "documents"), "doc_id", "text", RULE["percentage"])


@query(span_sql(_masked("documents", "doc_id"), "doc_id", "masked", RULE["person_name"]))
def e6_capital_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _spans(table(spark, d, "documents"), "doc_id", "text", RULE["person_name"])


def _words_sql(words: list[str]) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def entities_sql(source: str, key: str) -> str:
    """All entity rules in SQL, whose expressions have no look-around: a ZIP code is found with its state, a number with its name.

    source has key and text. Addresses apart, rules see a text whose letters beyond ASCII are masked. Spans that overlap fall into clusters; in each the longest is taken, then the earlier rule, and so on.
    """
    parts = []
    for n, (kind, pattern) in enumerate(rules.ENTITY_PATTERNS):
        pieces = [(pattern.replace(r"(?!\d)", ""), 0)]
        if kind == "zip_code":
            pieces = [(r"\b(?:ZIP|Zip|zip)[\s:]*\d{5}(?:-\d{4})?\b", 0), (r"[A-Z]{2}\s\d{5}(?:-\d{4})?\b", 3)]
        for p, skip in pieces:
            at, shown = f"start + {skip}", f"substr(value, {skip + 1})"
            if kind == "npi":
                at, shown = "start + length(value) - 10", "right(value, 10)"
            where = {"organization": f"length(trim(value)) >= 4 and trim(value) not in {_words_sql(rules.STATE_CODES)}", "person_name": f"not list_has_any(string_split_regex(trim(value), '\\s+'), [{_words_sql(rules.NOT_NAMES)[1:-1]}])"}.get(kind, "true")
            text = "case when true then regexp_replace(value, '^\\d{3}-\\d{2}', '***-**') end" if kind == "ssn" else f"trim({shown})"
            parts.append(f"select {key}, {n} as rule, '{kind}' as type, cast({at} as int) as start, cast(start + length(value) as int) as \"end\", {text} as text from ({span_sql(_masked(source, key), key, 'text' if kind in ('url', 'email') else 'masked', p)}) where {where}")
    return f"""with recursive found as ({' union all '.join(parts)}),
        reached as (select *, max("end") over (partition by {key} order by start, rule, "end" rows between unbounded preceding and 1 preceding) as reach from found),
        clustered as (select *, sum(case when reach is null or start >= reach then 1 else 0 end) over (partition by {key} order by start, rule, "end" rows between unbounded preceding and current row) as cluster from reached),
        ranked as (select *, row_number() over (partition by {key}, cluster order by start - "end", rule, start) as n from clustered),
        kept({key}, cluster, n, xs) as (
            select {key}, cluster, n, [{{'s': start, 'e': "end", 'type': type, 'text': text}}] from ranked where n = 1 union all
            select r.{key}, r.cluster, r.n, case when len(list_filter(k.xs, lambda x: r.start < x.e and x.s < r."end")) > 0 then k.xs else list_append(k.xs, {{'s': r.start, 'e': r."end", 'type': r.type, 'text': r.text}}) end
            from kept k join ranked r on r.{key} = k.{key} and r.cluster = k.cluster and r.n = k.n + 1)
        select {key}, x.type as type, x.s as start, x.e as "end", x.text as text from (select {key}, unnest(xs) as x from kept qualify n = max(n) over (partition by {key}, cluster))"""


FORM = """concat('Invoice for Maria Lopez, Case #', 1000 + {n} % 900, chr(10), 'SSN 123-45-', 1000 + {n} % 9000, ' phone 555-010-', 1000 + {n} % 8999, chr(10),
    'Date of Birth: 0', 1 + {n} % 9, '/15/1990', chr(10), 'Income ......... $', {n} % 999, '.50', chr(10), 'Status | Active', chr(10), 'ELIGIBILITY NOTICE', chr(10), '- renewal form', chr(10), '- chip card', chr(10), '1. apply', chr(10), '2. wait')"""


def _forms(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("c_custkey")
    text = F.concat(F.lit("Invoice for Maria Lopez, Case #"), (1000 + n % 900).cast("string"), F.lit("\nSSN 123-45-"), (1000 + n % 9000).cast("string"), F.lit(" phone 555-010-"), (1000 + n % 8999).cast("string"),
                    F.lit("\nDate of Birth: 0"), (1 + n % 9).cast("string"), F.lit("/15/1990\nIncome ......... $"), (n % 999).cast("string"), F.lit(".50\nStatus | Active\nELIGIBILITY NOTICE\n- renewal form\n- chip card\n1. apply\n2. wait"))
    return spread(table(spark, d, "customer").select("c_custkey")).select("c_custkey", text.alias("text"))  # some bytes a row in the file, a form of many lines here


_FORMS = f"(select c_custkey, {FORM.format(n='c_custkey')} as text from customer)"


@query(entities_sql(_FORMS, "c_custkey"))
def e1_form_entities(spark: SparkSession, d: str) -> DataFrame:
    return E.entity_rows(_forms(spark, d), ["c_custkey"], "text")


@query(entities_sql("documents", "doc_id"))
def e1_document_entities(spark: SparkSession, d: str) -> DataFrame:
    return E.entity_rows(table(spark, d, "documents"), ["doc_id"], "text")


@query(f"""with e as ({entities_sql(_FORMS, "c_custkey")}), f as (select c_custkey, type, text, min(start) as start from e group by all)
    select c_custkey, {len(rules.ENTITY_TYPES)} as types, count(*) filter (type = 'date') as dates, coalesce(string_agg(text, ',' order by start) filter (type = 'person_name'), '') as people from f group by c_custkey""")
def e1_categories(spark: SparkSession, d: str) -> DataFrame:
    found = _forms(spark, d).select("c_custkey", E.extract(F.col("text")).alias("e"))  # a column of its own: read 22 times, made once
    m = found.select("c_custkey", E.by_category(F.col("e")).alias("m"))
    return m.select("c_custkey", F.size("m").alias("types"), F.size(F.element_at("m", F.lit("date"))).cast("long").alias("dates"), F.array_join(F.element_at("m", F.lit("person_name")), ",").alias("people"))


@query("select * from (values " + ", ".join(f"({i}, '{k}', '{v}')" for i, (k, v) in enumerate(rules.ENTITY_LABELS.items())) + ") l(position, label, description)")
def e21_labels(spark: SparkSession, d: str) -> DataFrame:
    return E.label_table(spark)


# Spans of a job: the greedy choice as a recursion over the ranked spans.
@query(f"""with recursive {FRAMES}, s as (select job_id, event_id, cast(timestamp_ms // 3600000 % 700 as int) as a, cast(timestamp_ms // 3600000 % 700 + 1 + k % 30 as int) as b from frames where k is not null),
    r as (select *, row_number() over (partition by job_id order by b - a desc, event_id) as n from s),
    kept(job_id, n, ids, xs) as (
        select job_id, 0::bigint, []::bigint[], []::struct(a int, b int)[] from r group by job_id union all
        select job_id, n, case when clash then ids else list_append(ids, event_id) end, case when clash then xs else list_append(xs, {{'a': a, 'b': b}}) end
        from (select r.*, q.ids, q.xs, len(list_filter(q.xs, lambda x: r.a < x.b and x.a < r.b)) > 0 as clash from kept q join r on r.job_id = q.job_id and r.n = q.n + 1))
    select job_id, unnest(ids) as event_id from kept qualify n = max(n) over (partition by job_id)""")
def e7_resolved_spans(spark: SparkSession, d: str) -> DataFrame:
    kind = "struct<start:int,end:int,event_id:bigint>"
    hour = F.expr("timestamp_ms div 3600000 % 700").cast("int")
    s = frames(spark, d).filter("k is not null").select("job_id", F.struct(hour.alias("start"), (hour + 1 + F.col("k") % 30).alias("end"), "event_id").alias("s"), "event_id")
    items = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "s"))), lambda x: x["s"])
    return s.groupBy("job_id").agg(items.alias("items")).select("job_id", F.explode(resolve(F.col("items"), kind)).alias("x")).select("job_id", "x.event_id")


@query("select c_custkey, '***-**' || substr(printf('%03d-%02d-%04d', c_custkey % 900 + 100, c_custkey % 90 + 10, c_custkey % 9000 + 1000), 7) as masked, regexp_replace(c_name || ' / ' || c_mktsegment, '[^\\w\\-.]', '_', 'g') as file_name from customer")
def e8_masked(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("c_custkey")
    ssn = F.format_string("%03d-%02d-%04d", n % 900 + 100, n % 90 + 10, n % 9000 + 1000)
    return table(spark, d, "customer").select("c_custkey", mask_ssn(ssn).alias("masked"), safe_name(F.concat("c_name", F.lit(" / "), "c_mktsegment")).alias("file_name"))


@query(f"""with t as (select c_custkey, {FORM.format(n="c_custkey")} as text from customer),
    p as (select c_custkey, 0 as pattern, unnest(regexp_extract_all(text, '(?m)^(.{{2,50}}?)\\s*:\\s+(.+)$', 1)) as name, unnest(regexp_extract_all(text, '(?m)^(.{{2,50}}?)\\s*:\\s+(.+)$', 2)) as value from t union all
        select c_custkey, 1, unnest(regexp_extract_all(text, '(?m)^(.{{2,50}}?)\\s*[.]{{3,}}\\s*(.+)$', 1)), unnest(regexp_extract_all(text, '(?m)^(.{{2,50}}?)\\s*[.]{{3,}}\\s*(.+)$', 2)) from t union all
        select c_custkey, 2, unnest(regexp_extract_all(text, '(?m)^(.{{2,50}}?)\\s*\\|\\s+(.+)$', 1)), unnest(regexp_extract_all(text, '(?m)^(.{{2,50}}?)\\s*\\|\\s+(.+)$', 2)) from t)
    select c_custkey, trim(name) as name, trim(value) as value, lower(name) in ('date of birth', 'income', 'status') as is_known_field from p""")
def e9_key_values(spark: SparkSession, d: str) -> DataFrame:
    return X.key_values(_forms(spark, d), "c_custkey", "text").select("c_custkey", "name", "value", "is_known_field")


_PIPE = r"(?m)^([^\n|]{2,50}?)[ \t]*\|[ \t]+([^\n]+)$"


@query(f"""with p as (select doc_id, unnest(regexp_extract_all(text, '{_PIPE}', 1)) as name, unnest(regexp_extract_all(text, '{_PIPE}', 2)) as value, generate_subscripts(regexp_extract_all(text, '{_PIPE}', 1), 1) as i from documents)
    select doc_id, name, value from p where length(name) >= 2 qualify row_number() over (partition by doc_id, lower(name) order by i) = 1""")
def e9_table_pairs(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    both = F.arrays_zip(F.regexp_extract_all("text", F.lit(_PIPE.replace("(?m)", "(?md)")), F.lit(1)).alias("name"), F.regexp_extract_all("text", F.lit(_PIPE.replace("(?m)", "(?md)")), F.lit(2)).alias("value"))
    each = t.select("doc_id", F.posexplode(both).alias("i", "p")).select("doc_id", "i", "p.name", "p.value").filter(F.char_length("name") >= 2)
    first = F.row_number().over(Window.partitionBy("doc_id", F.lower("name")).orderBy("i"))
    return each.withColumn("r", first).filter("r = 1").select("doc_id", "name", "value")


LISTED = "replace(replace(replace(text, 'the ', chr(10) || '- the '), 'to ', chr(10) || '1. to '), 'que ', chr(10) || 'a) que ')"


def _listed(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    for a, b in (("the ", "\n- the "), ("to ", "\n1. to "), ("que ", "\na) que ")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return table(spark, d, "documents").select("doc_id", t.alias("text"))


_LINES = f"""l as (select doc_id, unnest(string_split({LISTED}, chr(10))) as raw, generate_subscripts(string_split({LISTED}, chr(10)), 1) - 1 as line_num from documents),
    t as (select doc_id, line_num, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') as line from l),"""


@query(f"""with {_LINES}
    c as (select *, case when regexp_matches(line, '^[•*●○‣⁃◦>-]\\s+.') then 'bulleted' when regexp_matches(line, '^\\d{{1,3}}[.)]\\s+.') then 'numbered' when regexp_matches(line, '^[a-zA-Z][.)]\\s+.') then 'lettered' else 'other' end as type from t),
    g as (select *, lag(type) over w as before, lead(type) over w as after from c window w as (partition by doc_id order by line_num)),
    i as (select *, sum(case when before is null or before <> type then 1 else 0 end) over (partition by doc_id order by line_num) as island from g),
    r as (select doc_id, island, type, min(line_num) as start_line, count(*) as n, arg_max(after, line_num) as after from i where type <> 'other' group by all)
    select doc_id, cast(start_line as int) as start_line, type, cast(n as int) as n from r where n >= 2 or (after is not null and after <> 'other')""")
def e10_lists(spark: SparkSession, d: str) -> DataFrame:
    return X.lists(_listed(spark, d), "doc_id", "text").select("doc_id", "start_line", "type", F.size("items").alias("n"))


@query("""with l as (select doc_id, unnest(string_split(text, chr(10))) as raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_num from documents),
    t as (select doc_id, line_num, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') as line from l), n as (select *, length(line) as n, length(regexp_replace(line, '[^\\p{L}]', '', 'g')) as letters from t),
    c as (select *, regexp_matches(line, '\\p{Lu}') and not regexp_matches(line, '\\p{Ll}') and n > 3 and n < 80 and not regexp_matches(line, '[:#]') as caps from n)
    select doc_id, cast(line_num as int) as line_num, line as header from c where (caps and letters >= 3 and letters > n * 0.5)
        or (not caps and regexp_matches(line, '\\p{Lu}') and not regexp_matches(line, '\\p{L}\\p{Lu}') and not regexp_matches(line, '(^|[^\\p{L}])\\p{Ll}') and n > 3 and n < 60 and not regexp_matches(line, '[:#]')
            and not regexp_matches(line, '[,.;]$|^\\d') and contains(line, ' ') and len(string_split_regex(line, '\\s+')) between 2 and 6)""")
def e11_headers(spark: SparkSession, d: str) -> DataFrame:
    return X.headers(table(spark, d, "documents"), "doc_id", "text")


_PAIR = " or ".join(f"length(trim(regexp_extract(line, '{p}', 1))) >= 2" for p in ("^(.{2,40}?)\\s*:\\s+.", "^(.{2,40}?)\\s*[.]{3,}\\s*.", "^(.{2,40}?)\\s*[|]\\s+.", "^(.{2,40}?)\\s*=\\s+."))


@query(f"""with {_LINES}
    c as (select doc_id, line_num, case when line = '' then 'blank'
        when regexp_matches(line, '\\p{{Lu}}') and not regexp_matches(line, '\\p{{Ll}}') and length(line) between 4 and 59 and not regexp_matches(left(line, 3), '\\d') then 'header'
        when not regexp_matches(line, '^\\d') and ({_PAIR}) then 'pair'
        when regexp_matches(line, '^[•*●○‣⁃◦>-]\\s+.') then 'bulleted' when regexp_matches(line, '^(\\d{{1,3}}[.)]\\s+|[a-zA-Z][.)]\\s+|(i{{1,3}}|iv|v|vi{{0,3}}|ix|x)[.)]\\s+).') then 'numbered'
        when regexp_matches(line, '\\t| {{3,}}') then 'data' else 'other' end as class from t)
    select doc_id, class, count(*) as n from c group by all""")
def e12_line_classes(spark: SparkSession, d: str) -> DataFrame:
    return X.structured_lines(_listed(spark, d), "doc_id", "text").groupBy("doc_id", "class").agg(F.count("*").alias("n"))


@query(f"""with {_LINES}
    c as (select *, case when line <> '' and not (regexp_matches(line, '\\p{{Lu}}') and not regexp_matches(line, '\\p{{Ll}}') and length(line) between 4 and 59 and not regexp_matches(left(line, 3), '\\d'))
            and not (not regexp_matches(line, '^\\d') and ({_PAIR})) then case when regexp_matches(line, '^[•*●○‣⁃◦>-]\\s+.') then 'bulleted' when regexp_matches(line, '^(\\d{{1,3}}[.)]\\s+|[a-zA-Z][.)]\\s+).') then 'numbered' else 'other' end else 'other' end as type from t),
    g as (select *, lag(type) over (partition by doc_id order by line_num) as before from c),
    i as (select *, sum(case when before is null or before <> type then 1 else 0 end) over (partition by doc_id order by line_num) as island from g)
    select doc_id, cast(min(line_num) as int) as start_line, type, cast(count(*) as int) as n from i where type <> 'other' group by doc_id, island, type""")
def e12_structured_lists(spark: SparkSession, d: str) -> DataFrame:
    return X.structured_lists(X.structured_lines(_listed(spark, d), "doc_id", "text"), "doc_id").select("doc_id", "start_line", "type", F.size("items").alias("n"))


@query("""with t as (select doc_id, replace(replace(text, 'the', '    '), 'oi', chr(10) || '*' || chr(10)) as text from documents),
    a as (select doc_id, regexp_replace(regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g'), ' {3,}', '  ', 'g') as text from t),
    k as (select doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: length(regexp_replace(x, '^\\s+|\\s+$', '', 'g')) <> 1 or regexp_matches(regexp_replace(x, '^\\s+|\\s+$', '', 'g'), '^[\\p{L}\\p{N}]$')), chr(10)) as text from a)
    select doc_id, md5(regexp_replace(regexp_replace(text, '\\n{4,}', chr(10) || chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) as cleaned from k""")
def e13_cleaned(spark: SparkSession, d: str) -> DataFrame:
    t = F.replace(F.replace("text", F.lit("the"), F.lit("    ")), F.lit("oi"), F.lit("\n*\n"))
    return table(spark, d, "documents").select("doc_id", F.md5(clean_ocr(t)).alias("cleaned"))


LEXICON = [("token", "TOKEN", "TECH_OR_SYSTEM"), ("the other", "OTHER", "PERSON_ROLE"), ("chip", "CHIP", "PROGRAM_BRAND"), ("chip", "CHIP", "ACRONYM"), ("renewal form", "FORM", "DOCUMENT_OR_RECORD"), ("form", "FORM", "DOCUMENT_OR_RECORD"), ("renewal", "RENEWAL", "DOCUMENT_OR_RECORD"),
           ("invoice for", "INVOICE", "FINANCIAL_TERM"), ("for maria", "FOR", "PERSON_ROLE"), ("maria lopez", "PERSON", "PERSON_ROLE"), ("of birth", "BIRTH", "PERSON_ROLE"), ("date of", "DATE", "PERSON_ROLE"), ("birth: 05/15", "MAY", "PERSON_ROLE")]
LABELS = ["TECH_OR_SYSTEM", "PERSON_ROLE", "ACRONYM", "DOCUMENT_OR_RECORD", "APPLICATION_PROCESS", "FINANCIAL_TERM"]


def chosen_sql(hits: str, key: str, rank: str, fields: str) -> str:
    """Of hits (key, start, "end", fields), the best by rank one after the other, without those that overlap a chosen one: a recursion in each cluster of overlapping hits."""
    packed = "{" + ", ".join(f"'{f}': {f}" for f in ["start", '"end"', *fields.split(", ")]).replace("'\"end\"'", "'end'") + "}"
    other = packed.replace(": ", ": r.")
    return f"""reached as (select *, max("end") over (partition by {key} order by start, {rank} rows between unbounded preceding and 1 preceding) as reach from ({hits})),
    clustered as (select *, sum(case when reach is null or start >= reach then 1 else 0 end) over (partition by {key} order by start, {rank} rows between unbounded preceding and current row) as cluster from reached),
    ranked as (select *, row_number() over (partition by {key}, cluster order by {rank}, start) as n from clustered),
    kept({key}, cluster, n, xs) as (select {key}, cluster, n, [{packed}] from ranked where n = 1 union all
        select r.{key}, r.cluster, r.n, case when len(list_filter(k.xs, lambda x: r.start < x.end and x.start < r."end")) > 0 then k.xs else list_append(k.xs, {other}) end
        from kept k join ranked r on r.{key} is not distinct from k.{key} and r.cluster = k.cluster and r.n = k.n + 1),
    chosen as (select {key}, x.* from (select {key}, unnest(xs) as x from kept qualify n = max(n) over (partition by {key}, cluster)))"""


#: The lexicon in SQL: each phrase searched by itself, the longest chosen first, the last declared entry of each, normalization over both.
_LEX = dict((p, (c, label)) for p, c, label in LEXICON)
_LEX_HITS = " union all ".join(f"""select c_custkey, '{p}' as phrase, {n} as ord, value, start, start + length(value) as "end" from ({span_sql(_FORMS, "c_custkey", "text", "(?i)" + chr(92) + "b" + p + chr(92) + "b")})""" for n, p in enumerate(sorted(_LEX, key=lambda p: -len(p))))
_LEX_SQL = f"""lex(phrase, canonical, label) as (values {", ".join(f"('{p}', '{c}', '{x}')" for p, (c, x) in _LEX.items())}), norm(phrase, canonical, label) as (values {", ".join("('" + "', '".join(r) + "')" for r in rules.NORMALIZATION)}),
    {chosen_sql(_LEX_HITS, "c_custkey", "ord", "phrase, value")},
    named as (select c_custkey, h.value as text, coalesce(n.label, l.label) as label, coalesce(n.canonical, l.canonical) as canonical_name, n.canonical as n_canonical, start
        from chosen h join lex l on l.phrase = h.phrase left join norm n on n.phrase = h.phrase)"""


@query(f"""with recursive {_LEX_SQL} select c_custkey, text, label, canonical_name, case when canonical_name = upper(canonical_name) and length(canonical_name) <= 8 then canonical_name else n_canonical end as normalized_acronym, start from named""")
def e14_lexicon(spark: SparkSession, d: str) -> DataFrame:
    return E.lexicon_entities(_forms(spark, d), "c_custkey", "text", LEXICON).select("c_custkey", "text", "label", "canonical_name", "normalized_acronym", "start")


# A lexicon that is a table: of each benchmark passage's first five words the pairs and the three in the middle, which overlap each other.
_PHRASES = """phrases as (select distinct phrase, item_id * 3 + k as place, k from (select item_id, k, lower(array_to_string(list_slice(string_split(text, ' '), case k when 0 then 1 when 1 then 2 else 4 end, case k when 0 then 2 when 1 then 4 else 5 end), ' ')) as phrase
        from benchmark, (values (0), (1), (2)) v(k))), lex as (select phrase, min(place) as place from phrases where length(phrase) > 1 and regexp_matches(phrase, '^[a-z0-9].*[a-z0-9]$') group by phrase)"""


#: A text with signs before and after each word: a phrase with such signs is found at word borders only, and places beyond them take no part in the search.
_BORDERED = "regexp_replace({}, '([\\p{{L}}\\p{{N}}_]+)', '\ufdd0' || '\\1' || '\ufdd1', 'g')"
_BARE_LENGTH = "length(replace(replace(x, '\ufdd0', ''), '\ufdd1', ''))"


@query(f"""with recursive {_PHRASES},
    texts as materialized (select doc_id, {_BORDERED.format("lower(text)")} as low from documents), sought as materialized (select phrase, place, {_BORDERED.format("phrase")} as form from lex),
    pairs as (select doc_id, phrase, place, string_split(low, form) as gaps from texts join sought on contains(low, form)),
    each as (select *, unnest(range(len(gaps) - 1)) as i from pairs),
    whole as (select *, cast(list_sum(list_transform(gaps[1:i + 1], lambda x: {_BARE_LENGTH})) + i * length(phrase) as int) as start, -length(phrase) as less from each),
    {chosen_sql('select doc_id, phrase, place, less, start, start + length(phrase) as "end" from whole', "doc_id", "less, place", "phrase, place")}
    select doc_id, phrase, start from chosen""")
def d11_phrase_table(spark: SparkSession, d: str) -> DataFrame:
    words = F.split("text", " ", -1)
    cuts = F.array(*[F.struct(F.lower(F.array_join(F.slice(words, a, n), " ")).alias("phrase"), (F.col("item_id") * 3 + k).alias("place")) for k, (a, n) in enumerate([(1, 2), (2, 3), (4, 2)])])
    each = table(spark, d, "benchmark").select(F.explode(cuts).alias("x")).select("x.phrase", "x.place", F.lit("PASSAGE").alias("canonical"), F.lit("PASSAGE").alias("label"))
    lexicon = each.filter(F.col("phrase").rlike("^[a-z0-9].*[a-z0-9]$"))
    return E.lexicon_matches(table(spark, d, "documents"), "doc_id", "text", lexicon).select("doc_id", "phrase", "start")


@query("""select doc_id, count(*) as n, min(strpos(lower(text), 'token')) - 1 as first_start from (select doc_id, text, unnest(regexp_extract_all(text, '(?i)\\btoken\\b')) from documents where regexp_matches(text, '(?i)\\btoken\\b')) group by doc_id""")
def d11_lexicon_join(spark: SparkSession, d: str) -> DataFrame:
    found = E.lexicon_entities(table(spark, d, "documents"), "doc_id", "text", [("token", "TOKEN", "TECH_OR_SYSTEM")])
    return found.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("start").cast("long").alias("first_start"))


@query("""with a as (select event_id, cast(event_id % 50 as int) as s, cast(event_id % 50 + 10 as int) as e from events), b as (select event_id, cast(event_id % 37 as int) as s, cast(event_id % 37 + 20 as int) as e from events)
    select event_id, 0 as layer, s as start from a union all select b.event_id, 1, b.s from b join a using (event_id) where not (a.s < b.e and b.s < a.e)""")
def e18_layers(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    layer = lambda m, size: table(spark, d, "events").select("event_id", (n % m).cast("int").alias("start"), (n % m + size).cast("int").alias("end"), F.lit("x").alias("text"), F.lit("y").alias("label"))
    return E.layered([layer(50, 10), layer(37, 20)], "event_id").select("event_id", "layer", "start")


@query(f"""with recursive {_LEX_SQL} select l.label, l.position, (select count(*) from named n where n.label = l.label) as total, (select count(distinct canonical_name) from named n where n.label = l.label) as names
    from (values {", ".join(f"('{x}', {i})" for i, x in enumerate(LABELS))}) l(label, position)""")
def e19_label_summary(spark: SparkSession, d: str) -> DataFrame:
    return E.label_summary(E.lexicon_entities(_forms(spark, d), "c_custkey", "text", LEXICON), LABELS)


_NORM = ", ".join("('" + "', '".join(r) + "')" for r in rules.NORMALIZATION)


@query(f"""with n(p, c, l) as (values {_NORM}), x(p, c, l) as (values ('chip', 'CHIP', 'ACRONYM'), ('token', 'TOKEN', 'TECH_OR_SYSTEM')),
    t as (select event_id, case event_id % 4 when 0 then ' Renewal ' when 1 then 'CHIP' when 2 then '1915(c)' else 'nothing' end as term from events)
    select event_id, coalesce(n.c, x.c) as canonical, coalesce(n.l, x.l) as label, coalesce(n.c, x.c) is not null as matched from t left join n on n.p = lower(trim(term)) left join x on x.p = lower(trim(term))""")
def e20_normalized(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id") % 4
    t = table(spark, d, "events").select("event_id", F.when(n == 0, " Renewal ").when(n == 1, "CHIP").when(n == 2, "1915(c)").otherwise("nothing").alias("term"))
    return E.normalize(t, "term", [("chip", "CHIP", "ACRONYM"), ("token", "TOKEN", "TECH_OR_SYSTEM")]).select("event_id", "canonical", "label", "matched")


@query("""select doc_id, cast(i * 1300 as int) as start, length(substr(text, i * 1300 + 1, 1500)) as size from (select doc_id, text, unnest(range(0, greatest(length(text) - 201, 0) // 1300 + 1)) as i from documents)""")
def e17_chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.explode(E.chunks(F.col("text"))).alias("c")).select("doc_id", F.col("c.offset").alias("start"), F.char_length("c.chunk").cast("long").alias("size"))


@query("""with h as (select doc_id as id, 'documents' as source, (length(lower(text)) - length(replace(lower(text), 'mail', ''))) // 4 as match_count, doc_id as pos from documents where contains(lower(text), 'mail')),
    b as (select item_id as id, 'benchmark' as source, (length(lower(text)) - length(replace(lower(text), 'mail', ''))) // 4 as match_count from benchmark where contains(lower(text), 'mail') and item_id not in (select id from h))
    select id, source, match_count from h union all select id, source, match_count from b""")
def k1_search(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.col("doc_id").alias("pos"))
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text", F.col("item_id").alias("pos"))
    return K.search([(docs, "documents"), (items, "benchmark")], " Mail ", "id", "text", "pos").select("id", "source", F.col("match_count").cast("long").alias("match_count"))


@query("""with g as (select doc_id, text, string_split(lower(text), 'token') as gaps from documents where contains(lower(text), 'token')),
    n as (select doc_id, text, unnest(range(1, least(len(gaps), 6))) as i, gaps from g),
    a as (select doc_id, text, i, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + (i - 1) * 5 as pos from n),
    b as (select *, greatest(pos - 60, 0) as lo, least(pos + 65, length(text)) as hi from a)
    select doc_id, cast(pos - lo + case when lo > 0 then 3 else 0 end as int) as match_start, case when lo > 0 then '...' else '' end || substr(text, cast(lo + 1 as bigint), cast(hi - lo as bigint)) || case when hi < length(text) then '...' else '' end as snippet from b""")
def k2_snippets(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "documents").filter(F.contains(F.lower("text"), F.lit("token")))
    return hits.select("doc_id", F.explode(snippets(F.col("text"), "token")).alias("s")).select("doc_id", "s.match_start", "s.snippet")


@query("""with w as (select source, doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{6,}')) as word from documents)
    select source, word, count(*) as n, count(distinct doc_id) as frames, min(doc_id) as first_frame, cast(sum(count(*)) over (partition by source) as bigint) as type_total from w group by source, word""")
def k3_roll_up(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents").select("source", "doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{6,}"), F.lit(0))).alias("word"))
    return K.roll_up(words, "source", "word", "doc_id")


@query("""with w as (select source, doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{6,}')) as word from documents),
    g as (select source, word, count(*) as n, list_sort(list(distinct doc_id)) as frames from w group by source, word), t as (select *, cast(sum(n) over (partition by source) as bigint) as type_total from g)
    select source, word, n, len(frames) as in_frames, md5(array_to_string(frames, ',')) as frames, type_total, count(*) over (partition by source) as type_unique from t where contains(lower(word), 'en')""")
def k3_frame_lists(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents").select("source", "doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{6,}"), F.lit(0))).alias("word"))
    told = K.entity_frames(words, "source", "word", "doc_id", "EN")
    return told.select("source", "word", "n", F.size("frames").cast("long").alias("in_frames"), F.md5(F.array_join("frames", ",")).alias("frames"), "type_total", "type_unique")


@query("""with w as (select distinct conv_id, turn, unnest(string_split_regex(lower(text), '\\s+')) as word from conversations), s as (select * from w where length(word) > 2),
    z as (select c.conv_id, c.turn, count(s.word) as size from conversations c left join s using (conv_id, turn) group by all),
    j as (select a.conv_id, a.turn, b.turn as other, count(*) as n from s a join s b on a.conv_id = b.conv_id and a.word = b.word and a.turn <> b.turn group by all),
    u as (select j.conv_id, j.turn, sum(n / (x.size + y.size - n)) as alike from j join z x on x.conv_id = j.conv_id and x.turn = j.turn join z y on y.conv_id = j.conv_id and y.turn = j.other group by all)
    select z.conv_id, z.turn, z.size, round(case when z.size > 0 then (1 - case when o > 0 then coalesce(alike, 0) / o else 0 end) * z.size else 0 end, 6) as unique_content
    from (select *, sum(case when size > 0 then 1 else 0 end) over (partition by conv_id) - case when size > 0 then 1 else 0 end as o from z) z left join u using (conv_id, turn)""")
def k4_unique_content(spark: SparkSession, d: str) -> DataFrame:
    got = K.unique_content(table(spark, d, "conversations"), "conv_id", "turn", "text")
    return got.select("conv_id", "turn", F.col("size").cast("long").alias("size"), F.round("unique_content", 6).alias("unique_content"))


@query(f"with {FRAMES} select event_id, round((k + 1) * greatest(frame_index % 4, 1) * greatest(value / 100, 0.1), 6) as density, 10 * (k % 3) + 3 * (k % 5) + 2 * (k % 7) + k % 2 + frame_index % 3 as data_rich from frames")
def k4_densities(spark: SparkSession, d: str) -> DataFrame:
    k, i = F.col("k"), F.col("frame_index")
    return frames(spark, d).select("event_id", F.round(K.density(k + 1, i % 4, F.col("value")), 6).alias("density"), K.data_rich(k % 3, k % 5, k % 7, k % 2, i % 3).alias("data_rich"))


@query(f"""with {FRAMES}, p as (select *, row_number() over (partition by job_id order by value desc, event_id) as r, count(*) over (partition by job_id) as n from frames where value > 0)
    select job_id, event_id, value from p where r <= greatest(1, ceil(n * 0.5))""")
def k5_top_half(spark: SparkSession, d: str) -> DataFrame:
    return K.top_half(frames(spark, d), "job_id", "value", "event_id").select("job_id", "event_id", "value")


_KINDS = {"email": EMAIL, "percentage": r"[0-9]+(?:\.[0-9]+)?%", "number": "[0-9]+", "capitals": "[A-Z][a-z]+ [A-Z][a-z]+"}


def _categories() -> Column:
    """A map from kind to the texts that a document has of it."""
    return F.map_from_arrays(F.array(*[F.lit(k) for k in _KINDS]), F.array(*[F.regexp_extract_all("text", F.lit(p), F.lit(0)) for p in _KINDS.values()]))


_CATEGORIES_SQL = " union all ".join(f"select doc_id, source, text, '{k}' as type, regexp_extract_all(coalesce(text, ''), '{p}') as texts from documents" for k, p in _KINDS.items())


@query(f"with c as ({_CATEGORIES_SQL}) select source, type, cast(sum(len(texts)) as bigint) as total from c group by all")
def k6_chip_counts(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    return K.chip_counts(t.select("source", _categories().alias("c")), ["source"], "c")


@query(f"""with c as ({_CATEGORIES_SQL}), e as (select doc_id, type, unnest(texts) as x, generate_subscripts(texts, 1) as i from c), f as (select doc_id, type, x, min(i) as i from e group by all)
    select c.doc_id, c.type, coalesce((select string_agg(x, ' ' order by i) from f where f.doc_id = c.doc_id and f.type = c.type), '') as texts from c""")
def k7_distinct(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    return t.select("doc_id", F.explode(K.distinct_texts(_categories())).alias("type", "texts")).select("doc_id", "type", F.array_join("texts", " ").alias("texts"))


@query(f"with c as ({_CATEGORIES_SQL}) select doc_id, count(*) filter (len(texts) > 0) as types from c group by doc_id")
def k4_entity_diverse(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    return t.select("doc_id", K.entity_diverse(_categories()).cast("long").alias("types"))


@query("select conv_id, cast(sum(length(text)) as bigint) as chars, cast(sum(turn) as bigint) as turns, md5(string_agg(text, chr(10) || chr(10) order by turn)) as text from conversations group by conv_id")
def k8_merged_runs(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").withColumns({"chars": F.char_length("text"), "turns": F.col("turn")})
    return K.merge_runs(c, "conv_id", "turn", ["chars", "turns"], "text").select("conv_id", "chars", "turns", F.md5("text").alias("text"))


@query(f"with c as ({_CATEGORIES_SQL}) select doc_id, any_value(length(coalesce(text, ''))) as text_length, cast(sum(len(texts)) as bigint) as entity_count, any_value(doc_id % 3) as table_count, any_value((doc_id % 101)::double) as confidence, any_value(case when doc_id % 2 = 0 then 'plain' else 'sharpened' end) as strategy from c group by doc_id")
def k10_run_summary(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    t = table(spark, d, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    told = K.run_summary(F.col("text"), _categories(), n % 3, (n % 101).cast("double"), F.when(n % 2 == 0, "plain").otherwise("sharpened"))
    return t.select("doc_id", told.alias("s")).select("doc_id", F.col("s.text_length").cast("long").alias("text_length"), F.col("s.entity_count").cast("long").alias("entity_count"), "s.table_count", "s.confidence", "s.strategy")


_STOP = "(" + ", ".join(f"'{w}'" for w in rules.TITLE_STOP_WORDS) + ")"


@query(f"""with e as (select *, row_number() over (partition by conv_id order by turn) as e from conversations),
    f as (select conv_id, text, row_number() over (partition by conv_id order by turn) as f from e where e <= 50 and trim(coalesce(text, '')) <> ''),
    w as (select conv_id, f, lower(unnest(regexp_extract_all(text, '[A-Za-z]{{3,}}'))) as word, generate_subscripts(regexp_extract_all(text, '[A-Za-z]{{3,}}'), 1) as p from f where f <= 5),
    c as (select conv_id, word, count(*) as n, min(f * 1000000 + p) as first from w where word not in {_STOP} group by all),
    r as (select *, row_number() over (partition by conv_id order by n desc, first) as r from c),
    t as (select conv_id, string_agg(upper(left(word, 1)) || substr(word, 2), ' ' order by r) as title from r where r <= 5 group by conv_id)
    select conv_id, case when length(title) > 60 then left(title, 57) || '...' else title end as title from t""")
def r8_auto_title(spark: SparkSession, d: str) -> DataFrame:
    return K.title_words(table(spark, d, "conversations"), "conv_id", "text", "turn")


@query("""with p as (select page_id, list_transform(regexp_extract_all(html, '<p>([^<]*)', 1), lambda x: x) as ps from pages) select page_id, count(*) as n from (select page_id, unnest(list_distinct(list_filter(ps, lambda x: x <> ''))) from p) group by page_id""")
def o14_html_texts(spark: SparkSession, d: str) -> DataFrame:
    ps = F.array_distinct(F.filter(F.regexp_extract_all("html", F.lit("<p>([^<]*)"), F.lit(1)), lambda x: x != ""))
    return table(spark, d, "pages").select("page_id", F.size(ps).cast("long").alias("n")).filter("n > 0")


@query("select c_custkey, 2 as n_rows, c_name || '|' || c_mktsegment || '/' || c_custkey as cells from customer")
def o14_html_rows(spark: SparkSession, d: str) -> DataFrame:
    html = F.concat(F.lit("<table><tr><th>h</th></tr><tr class='a'><td> <b>"), "c_name", F.lit("</b> </td><td>"), "c_mktsegment", F.lit("</td><td> </td></tr>\n<TR><td>"), F.col("c_custkey").cast("string"), F.lit("</td></TR><tr><td></td></tr></table>"))
    rows = table(spark, d, "customer").select("c_custkey", X.html_rows(html).alias("rows"))
    return rows.select("c_custkey", F.size("rows").alias("n_rows"), F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), "/").alias("cells"))


@query("""with l as (select doc_id, list_filter(list_transform(string_split_regex(replace(text, '. ', chr(10) || chr(10)), '\\n{2,}'), lambda x: regexp_replace(regexp_replace(regexp_replace(x, '^#+', ''), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') as ls from documents),
    e as (select doc_id, unnest(ls) as x, generate_subscripts(ls, 1) as i from l), f as (select doc_id, x, min(i) as i from e group by all), r as (select *, row_number() over (partition by doc_id order by i) as r from f)
    select doc_id, md5(string_agg(x, '~' order by r)) as lines from r where r <= 18 group by doc_id""")
def o18_readable_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = readable_lines(F.replace("text", F.lit(". "), F.lit("\n\n")))
    return table(spark, d, "documents").select("doc_id", lines.alias("l")).filter(F.size("l") > 0).select("doc_id", F.md5(F.array_join("l", "~")).alias("lines"))


@query("""select o_custkey as key, o_orderkey as pos, '{"o_orderstatus":"' || o_orderstatus || '","o_orderpriority":"' || o_orderpriority || '"}' as json from orders""")
def b7_json_export(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("pos"), "o_orderstatus", "o_orderpriority")
    return writers.json_lines(o, ["o_orderstatus", "o_orderpriority"], ["pos"], "key")


@query("select conv_id, md5(string_agg('== ' || role || ' ==' || chr(10) || text, chr(10) || chr(10) order by turn)) as text from conversations group by conv_id")
def b8_text_export(spark: SparkSession, d: str) -> DataFrame:
    return writers.text_export(table(spark, d, "conversations"), "conv_id", "turn", "role", "text").select("conv_id", F.md5("text").alias("text"))


@query("""with s as (select o_custkey, o_orderkey % 5 + 1 as bucket, '<li><b>' || o_orderpriority || '</b> ' || 'total &amp; &lt;' || o_orderstatus || '&gt;' || '</li>' as li, o_orderkey from orders),
    c as (select c_custkey, b.b, b.t, coalesce((select string_agg(li, '' order by o_orderkey) from s where s.o_custkey = c_custkey and s.bucket = b.b), '') as items from customer, (values (1, 'Case List'), (2, 'Program Eligibility'), (3, 'Eligibility Evidence'), (4, 'State Eligibility Determination'), (5, 'Unknown')) b(b, t))
    select c.c_custkey, md5('<html><body><h1>' || any_value(case when c.c_custkey % 4 = 0 then 'not provided' else x.c_name end) || '</h1>' || string_agg('<section><h2>' || b || '. ' || t || '</h2><ul>' || items || '</ul></section>', '' order by b)
        || '<footer>' || any_value((select count(*) from s where s.o_custkey = c.c_custkey)) || ' items</footer></body></html>') as html from c join customer x on x.c_custkey = c.c_custkey group by c.c_custkey""")
def b4_html_report(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), (F.col("o_orderkey") % 5 + 1).cast("int").alias("bucket"), "o_orderkey", F.col("o_orderpriority").alias("heading"), F.concat(F.lit("total & <"), "o_orderstatus", F.lit(">")).alias("summary"))
    jobs = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, "").otherwise(F.col("c_name")).alias("title"))
    return writers.html_report(s, jobs, "c_custkey", "o_orderkey").select("c_custkey", F.md5("html").alias("html"))


@query("""with s as (select o_custkey, o_orderkey % 5 + 1 as bucket, o_orderkey,
        '<article>' || case when o_orderkey % 7 = 0 then '<p>No screenshot recorded</p>' when o_orderkey % 7 = 1 then '<p>Image not available</p>' else '<img src="data:' || case o_orderkey % 3 when 0 then 'image/jpeg' else 'image/png' end || ';base64,' || to_base64(encode(o_orderpriority)) || '">' end
        || '<p>Captured at ' || printf('%02d:%02d', o_orderkey * 777 // 60000, o_orderkey * 777 // 1000 % 60) || '</p><h3>' || o_orderpriority || '</h3><p>a &amp; b</p><ul><li>' || o_orderstatus || '</li><li>&lt;2&gt;</li></ul><p></p></article>' as li from orders),
    c as (select c_custkey, b.b, b.t, coalesce((select string_agg(li, '' order by o_orderkey) from s where s.o_custkey = c_custkey and s.bucket = b.b), '') as items from customer, (values (1, 'Case List'), (2, 'Program Eligibility'), (3, 'Eligibility Evidence'), (4, 'State Eligibility Determination'), (5, 'Unknown')) b(b, t))
    select c.c_custkey, md5('<html><body><header>' || any_value('<div><b>PERM ID</b> ' || case when c.c_custkey % 4 = 0 then 'not provided' else x.c_name end || '</div><div><b>Recipient</b> ' || x.c_mktsegment || '</div><div><b>Date of Service</b> not provided</div><div><b>State</b> not provided</div><div><b>Case Type</b> not provided</div><div><b>Sample</b> not provided</div>')
        || '</header>' || string_agg('<section><h2>' || b || '. ' || t || '</h2>' || items || '</section>', '' order by b) || '</body></html>') as html from c join customer x on x.c_custkey = c.c_custkey group by c.c_custkey""")
def b4_capture_report(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("o_orderkey")
    path = F.when(n % 7 == 0, "").otherwise(F.concat(F.lit("shot."), F.when(n % 3 == 0, "JPG").otherwise("png")))
    captures = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), (n % 5 + 1).cast("int").alias("bucket"), "o_orderkey", F.when(n % 7 > 1, F.col("o_orderpriority").cast("binary")).alias("image"), path.alias("image_path"), (n * 777).alias("captured_at_ms"),
        F.col("o_orderpriority").alias("heading"), F.lit("a & b").alias("summary"), F.array("o_orderstatus", F.lit("<2>")).alias("key_points"), F.lit(None).cast("string").alias("notes"))
    jobs = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, "—").otherwise(F.col("c_name")).alias("perm_id"), F.col("c_mktsegment").alias("recipient"))
    return writers.capture_report(captures, jobs, "c_custkey", "o_orderkey").select("c_custkey", F.md5("html").alias("html"))


def _capitals(batch: list[str]) -> list[list[tuple[str, str, float]]]:
    """A stand-in for a model: capitalized words, surer of long ones."""
    import re

    return [[(m, "a capitalized word", min(len(m) / 20, 1.0)) for m in re.findall(r"\b[A-Z][a-z]{6,}\b", chunk, re.ASCII)] for chunk in batch]


@query("""with c as (select doc_id, i * 1300 as at_, substr(text, i * 1300 + 1, 1500) as chunk from (select doc_id, text, unnest(range(0, greatest(length(text) - 201, 0) // 1300 + 1)) as i from documents)),
    f as (select doc_id, at_, chunk, unnest(list_distinct(regexp_extract_all(chunk, '\\b[A-Z][a-z]{6,}\\b'))) as word from c)
    select distinct doc_id, cast(at_ + strpos(chunk, word) - 1 as int) as start, word as text, round(least(length(word) / 20, 1.0), 4) as confidence from f where length(word) / 20 >= 0.4""")
def e17_chunk_layer(spark: SparkSession, d: str) -> DataFrame:
    found = E.chunk_layer(table(spark, d, "documents"), "doc_id", "text", _capitals, {"a capitalized word": "NAME"}, 0.4)
    return found.select("doc_id", "start", "text", "confidence")
