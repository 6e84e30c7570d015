"""The registered queries in DuckDB SQL, written on their own: set operations where the engine uses arrays, and the
other way round. Rule tables are shared, as they are fixed values."""

from __future__ import annotations

from ..functions import rules
from ..operators import responses
from ..sources.virtual import ctes

ORACLES: dict[str, str] = {}


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def first(pairs: list[tuple[str, str]]) -> str:
    return "case " + " ".join(f"when {c} then {v}" for c, v in pairs) + " end"


def add(name: str, body: str, *views: str, more: str = "") -> None:
    """A query over views, with further CTEs in `more`."""
    head = ctes(*views) if views else "with none as (select 1)"
    ORACLES[name] = f"{head}{', ' + more if more else ''}\n{body}"


def total(words: list[str], each) -> str:
    return "(" + " + ".join(each(w) for w in words) + ")"


hits = lambda text, words: total(words, lambda w: f"(contains({text}, {lit(w)}))::int")
any_of = lambda text, words: "(" + " or ".join(f"contains({text}, {lit(w)})" for w in words) + ")"
matches = lambda text, patterns: total(patterns, lambda p: f"(regexp_matches({text}, {lit(p)}))::int")
STRIP = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
strip = lambda text: f"trim({text}, {STRIP})"
NL = "chr(10)"

HEADING = first([(f"len(list_filter(string_split(text, {NL})[1:10], lambda l: regexp_matches(lower(l), {lit(p)}))) > 0", lit(p)) for p in rules.HEADING_PATTERNS])
TABS = f"""tabs as (
  select doc_id, doc, table_index, n_rows, list_concat([hc], case when n_rows > 1 then list_transform(range(1, n_rows), lambda i: list_transform(range(0, len(hc)), lambda j: 'r' || i || 'c' || j)) else [] end) as cells,
         lower(array_to_string(list_transform(hc, lambda c: coalesce(c, '')), ' ')) as head_empty,
         lower(array_to_string(list_transform(hc, lambda c: coalesce(c, 'None')), ' ')) as head_none
  from (select *, list_transform(string_split(header, '|'), lambda c: nullif(c, '')) as hc from v_page_tables) t
)"""
SCORED = f"""{TABS}, tscore as (
  select doc_id, m as table_matches from (
    select doc_id, {matches("head_empty", rules.TABLE_PATTERNS)} as m, row_number() over (partition by doc_id order by table_index) as k
    from tabs where len(cells) >= 2 and {matches("head_empty", rules.TABLE_PATTERNS)} >= 2) t where k = 1
), areas as (
  select doc_id, sum(width * height) as image_area from v_page_images group by doc_id
), parts as (
  select p.*, {HEADING} as heading,
         {first([(f"regexp_matches(lower(text), {lit(c)})", lit(c)) for c in rules.CAPTION_PATTERNS])} as caption,
         {total(rules.DENSITY_KEYWORDS, lambda k: f"(length(lower(text)) - length(replace(lower(text), {lit(k)}, ''))) // {len(k)}")} as keywords,
         len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) as words,
         t.table_matches, coalesce(a.image_area, 0) / (width * height) as covered
  from v_pages p left join tscore t using (doc_id) left join areas a using (doc_id)
), flags as (
  select *, table_matches is not null as has_table, covered >= 0.2::double and caption is not null as has_diagram,
         words > 0 and (keywords::double / words::double) * 100 >= 2 as dense,
         page_number::double / total_pages::double between 0.2::double and 0.7::double as positioned
  from parts
), points as (
  select *, (heading is not null)::int * 3 as heading_score, has_table::int * 4 as table_score, has_diagram::int * 2 as diagram_score,
         dense::int * 2 as keyword_score, positioned::int as position_score from flags
), summed as (
  select *, heading_score + table_score + diagram_score + keyword_score + position_score as score,
         list_filter([case when heading is not null then 'heading: ' || heading end, case when has_table then 'table columns: ' || table_matches end,
                      case when has_diagram then 'diagram caption: ' || caption end, case when dense then 'keywords: ' || keywords || ' in ' || words end,
                      case when positioned then 'position' end], lambda r: r is not null) as reasons
  from points
), scored as (
  select *, ((score >= 2 and not has_table and not has_diagram) or (length({strip("text")}) < 100 and has_diagram)) as unusual,
         row_number() over (partition by doc, score >= 5 order by score desc, page_number) as rank from summed
)"""
PAGE_VIEWS = ("v_pages", "v_page_tables", "v_page_images")


def scored(name: str, body: str, more: str = "") -> None:
    add(name, body, *PAGE_VIEWS, more=SCORED + (", " + more if more else ""))


IMAGES = f"""measured as (
  select i.*, i.width * i.height as area, (i.width * i.height) / (p.width * p.height) as ratio, (i.width * i.height) / (p.width * p.height) > 0.2::double as is_large
  from v_page_images i join v_pages p using (doc_id)
), grouped as (
  select doc_id, cast(count(*) as int) as n_images, bool_or(is_large) as any_large, string_agg(image_index || ':' || is_large, ' ' order by image_index) as images from measured group by doc_id
), worded as (
  select g.*, p.doc, p.page_number, array_to_string(list_filter([{", ".join(f"case when contains(lower(p.text), {lit(k)}) then {lit(k)} end" for k in rules.IMAGE_KEYWORDS)}], lambda k: k is not null), ', ') as keywords,
         regexp_matches(lower(p.text), {lit(rules.FIGURE_PATTERN)}) as figure
  from grouped g join v_pages p using (doc_id)
), analysis as (
  select *, (((case when any_large then 0.5::double else 0.0::double end) + (case when n_images > 1 then 0.2::double * (n_images - 1) else 0.0::double end))
             + (case when keywords <> '' then 0.3::double else 0.0::double end)) + (case when figure then 0.2::double else 0.0::double end) as confidence,
         array_to_string(list_filter([case when any_large then 'large image' end, case when n_images > 1 then 'images: ' || n_images end,
                                      case when keywords <> '' then 'keywords: ' || keywords end, case when figure then 'figure number' end], lambda r: r is not null), '; ') as reasons
  from worded
)"""

# --- scans, sources, sinks
add("s2_rescan", "select doc, doc_id, page_number, cast(length(coalesce(text, '')) as int) as n_chars, md5(coalesce(text, '')) as text_md5 from v_pages", "v_pages")
SHEETS = "sheets as (select s.url, u.t, u.k, len(s.parts) as n from (select url, string_split(html, chr(12)) as parts from pages where html is not null) s, lateral (select unnest(s.parts) as t, generate_subscripts(s.parts, 1) as k) u)"
add("s1_page_scan", "select url as doc, cast(k as int) as page_number, cast(n as int) as total_pages, cast(length(t) as int) as n from sheets", more=SHEETS)
add("s3_image_scan", "select url as doc, cast(k as int) as page_number, cast(0 as int) as image_index, cast(strlen(t) as int) as n from sheets", more=SHEETS)
add("s4_page_numbers", "select doc, doc_id, page_number from v_pages", "v_pages")
add("s5_text_ninth_null", "select doc_id, md5(case when doc_id % 9 <> 0 then text else '' end) as text_md5 from v_pages", "v_pages")
add("s6_single_page", "select doc, page_number, md5(text) as text_md5 from v_pages where page_number = 3", "v_pages")
add("s7_tables", "select doc_id, table_index, n_rows from v_page_tables where n_rows >= 2", "v_page_tables")
# What the words and lines were made from: nothing is rebuilt here.
MERGED = "t.doc_id % 3 = 0 and n_rows > 1 and len(hc) > 1"
add(
    "s7_ruled_tables",
    f"""select doc_id, 0 as table_index, array_to_string(list_transform(range(0, n_rows), lambda i: array_to_string(list_transform(range(0, len(hc)), lambda j:
         case when {MERGED} and i = 1 and j = 1 then '~' when (i + j) % 7 = 6 then '' when i = 0 then replace(coalesce(hc[j + 1], ''), ' ', chr(10)) else 'r' || i || 'c' || j end), '|')), '/') as cells
from (select *, list_transform(string_split(header, '|'), lambda c: nullif(c, '')) as hc from v_page_tables) t
union all select doc_id, 1, 'beside' from v_page_tables where doc_id % 4 = 0""",
    "v_page_tables",
)
add(
    "s5_positioned_text",
    """select doc_id, cast(length(said) as int) as n_chars, md5(said) as text_md5 from (
    select doc_id, string_agg(said, chr(10) order by line) as said from (
        select doc_id, line, string_agg(word, ' ' order by i) as said from (
            select doc_id, word, i, i // 5 as line from (select doc_id, unnest(w) as word, generate_subscripts(w, 1) - 1 as i from (
                select doc_id, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents) d) e) f
        group by doc_id, line) g
    group by doc_id) h""",
)
STORED = "stored as (select i.*, p.page_number, case when (i.doc_id + i.image_index) % 7 <> 0 then i.doc || '-' || i.image_index end as data from v_page_images i join v_pages p using (doc_id))"
add("s8_content_images", "select doc_id, image_index, base64(encode(data)) as data from stored where data is not null", "v_page_images", "v_pages", more=STORED)
add("s9_detector_images", "select doc_id, image_index, base64(encode(data)) as data from stored", "v_page_images", "v_pages", more=STORED)
add("s10_bulk_images", "select doc, page_number, image_index from stored where page_number in (2, 5, 100000) and data is not null", "v_page_images", "v_pages", more=STORED)
add("s11_image_files", "select regexp_replace(doc, '[^\\w.-]+', '_', 'g') || '/page_' || page_number || '_img_' || image_index || '.png' as name, md5(data) as content_md5 from stored where data is not null", "v_page_images", "v_pages", more=STORED)
asked = lambda content, part="''": f"{lit(responses.PIN_ASK)} || {part} || chr(10) || {content}"
REQUEST = f"""'[{{"role":"system","content":' || to_json({lit(responses.PIN_SYSTEM)}) || '}},{{"role":"user","content":' || to_json({asked("component_name")}) || '}}]'"""
add("s12_chat_answers", f"""select comp_id, '{{"component_name": "stub", "package": {{"type": "DIP", "pin_count": ' || (length({REQUEST}) % 8) || '}}, "pins": []}}' as response from v_components""", "v_components")
LEDGER = """asked as (select p_partkey, p_brand || ' ' || p_size as request from part
), wanted as (select distinct request, sha256('Unsteady' || chr(31) || chr(31) || request) as digest, strpos('0123456789abcdef', sha256(request)[1]) - 1 as h from asked
), tries as (select *, n as attempt, h = 15 or (h + n) % 3 = 0 as fails, '{"component_name": "stub", "package": {"type": "DIP", "pin_count": ' || (length(request) % 8) || '}, "pins": []}' as answer from wanted, (select unnest([1, 2]) as n) t
), calls as (select digest, request, cast(attempt as int) as attempt, case when fails then 'failed' else 'answered' end as outcome, case when not fails then answer end as response,
       case when fails then 'ConnectionError: attempt ' || attempt end as error from tries t where attempt = 1 or exists (select 1 from tries f where f.digest = t.digest and f.attempt = 1 and f.fails))"""
add("s12_ledger_calls", "select digest, attempt, outcome, response, error from calls", more=LEDGER)
add("s12_ledger_answers", "select p_partkey, c.response, c.attempt as attempts, c.error as call_error from asked a join calls c using (request) where c.attempt = (select max(attempt) from calls m where m.request = a.request)", more=LEDGER)
add("s13_vision_answers", """select doc_id, image_index, '{"status": 1}' as response from v_page_images""", "v_page_images")
unfenced = lambda r: strip(f"regexp_replace(regexp_replace(regexp_replace({strip(r)}, '^```json', ''), '^```', ''), '```$', '')")
add("s14_layout_text", f"select comp_id, case when comp_id % 5 = 0 then {unfenced('response')} when comp_id % 5 < 4 then response end as layout_text from v_llm_responses", "v_llm_responses")
add("s17_valid_inputs", "select file_id, path from v_files where lower(right(path, 4)) = '.pdf'", "v_files")
add("s18_listing", "select path from v_files where lower(right(path, 4)) = '.pdf' order by path", "v_files")
add("s19_base64", "select doc_id, md5(base64(encode(text))) as encoded_md5 from v_pages", "v_pages")

# --- page scores
scored("p1_heading_score", "select doc_id, heading, heading_score from scored")
add("p2_heading_line", f"select doc_id, ({HEADING}) is not null as is_heading from v_pages", "v_pages")
scored("p3_table_score", "select doc_id, table_matches, table_score, has_table from scored")
add("p4_header_text", "select doc_id, table_index, head_empty as header_text from tabs", "v_page_tables", more=TABS)
scored("p5_diagram_score", "select doc_id, has_diagram, diagram_score from scored")
scored("p6_keyword_density", "select doc_id, cast(keywords as int) as keywords, cast(words as int) as words, keyword_score from scored")
scored("p7_position_score", "select doc_id, page_number, position_score from scored")
scored("p8_page_score", "select doc, page_number, score, array_to_string(reasons, '; ') as reasons from scored")
scored("p9_unusual", "select doc_id, unusual from scored")
scored("p10_relevant_pages", "select doc, page_number, score, cast(rank as int) as rank from scored where score >= 5")
scored("p11_verification_mark", "select doc_id, score, unusual or (score >= 3 and score < 5) as needs_verification from scored")
scored("p12_low_confidence", "select doc, page_number, score from scored where score = 4")
scored("p13_retry_lower", "select doc, page_number, score from (select *, max(score) over (partition by doc) as top from scored) t where score >= case when top >= 5 then 5 else 3 end")

# --- image pages
image = lambda name, body: add(name, body, "v_page_images", "v_pages", more=IMAGES)
image("i1_image_area", "select doc_id, image_index, area, ratio, is_large from measured")
image("i2_image_confidence", "select doc_id, n_images, any_large, confidence from analysis")
add("i3_found_keywords", f"select doc_id, array_to_string(list_filter([{', '.join(lit(k) for k in rules.IMAGE_KEYWORDS)}], lambda k: contains(lower(text), k)), ', ') as keywords from v_pages", "v_pages")
image("i4_image_pages", "select doc, page_number, confidence, cast(row_number() over (partition by doc order by confidence desc, page_number) as int) as rank from analysis where confidence >= 0.3::double and any_large")
image("i5_page_analysis", "select doc_id, images, reasons from analysis")

# --- content
excluded = lambda t: "(" + " or ".join(f"contains({t}, {lit(f' {e} ')}) or ends_with({t}, {lit(e)})" for e in rules.EXCLUSIONS) + ")"
section = lambda t: f"({t} <> '' and ({any_of(f'lower({t})', rules.STRONG_PHRASES)} or ({any_of(f'lower({t})', rules.SECTION_KEYWORDS)} and not {excluded(f'lower({t})')}) or regexp_matches(lower({t}), {lit(rules.DIAGRAM_LINE)})))"
PIN_TABLE = f"{hits('head_none', rules.TABLE_KEYWORDS)} >= 2"


def segments(source: str, key: str) -> str:
    """Lines of the texts of `source` (key, text), numbered, and blocks between markers."""
    return f"""lines as (
  select {key}, u.pos as pos, u.line as line from (select {key}, string_split(text, {NL}) as l from {source}) s, lateral (select unnest(l) as line, generate_subscripts(l, 1) as pos) u
), numbered as (
  select *, starts_with({strip("line")}, '--- Page') as marker, sum(starts_with({strip("line")}, '--- Page')::int) over (partition by {key} order by pos) as seg from lines
), heads as (
  select {key}, seg, try_cast({strip(f"replace(replace({strip('line')}, '--- Page', ''), '---', '')")} as int) as page from numbered where marker
), blocks as (
  select n.{key}, n.seg, h.page, string_agg(n.line, {NL} order by n.pos) as text
  from numbered n join heads h on h.{key} = n.{key} and h.seg = n.seg where not n.marker and h.page is not null group by n.{key}, n.seg, h.page
)"""


CONTENT = f"""candidates as (select * from scored where score >= 5), content_text as (
  select doc, string_agg(page_number::varchar, ',' order by score desc, page_number) as pages,
         string_agg('--- Page ' || page_number || ' ---' || {NL} || text || {NL} || {NL}, '' order by page_number) as text
  from candidates group by doc
), own_tables as (
  select c.doc, c.page_number as page, t.table_index, t.cells, t.head_none from candidates c join tabs t using (doc_id) where c.has_table and len(t.cells) >= 2
), own_images as (
  select c.doc, count(*) as n_images from candidates c join v_page_images i using (doc_id) where c.has_diagram group by c.doc
)"""


def contents(name: str, body: str, more: str = "") -> None:
    scored(name, body, CONTENT + (", " + more if more else ""))


def listed(where: str = "true") -> str:
    return f"coalesce((select string_agg(page || ':' || table_index || ':' || len(cells), ' ' order by page, table_index) from own_tables o where o.doc = c.doc and {where}), '')"


IMAGE_COUNT = "cast(coalesce((select n_images from own_images i where i.doc = c.doc), 0) as int)"
contents("c1_gated_extract", f"select doc, pages, md5(text) as text_md5, {listed()} as tables, {IMAGE_COUNT} as n_images from content_text c")
add("c2_page_marker", f"select doc_id, md5('--- Page ' || page_number || ' ---' || {NL} || text) as marked_md5 from v_pages", "v_pages")
KEEP = f"(page in (select page from own_tables o where o.doc = b.doc and {PIN_TABLE}) or {section('b.text')} or {any_of('lower(b.text)', rules.STRONG_HEADINGS)})"
FILTERED = segments("content_text", "doc") + f""", kept as (select * from blocks b where {KEEP}), filtered as (
  select c.doc, c.pages, coalesce(k.text, '') as text from content_text c left join (
    select doc, string_agg('--- Page ' || page || ' ---' || {NL} || text, {NL} || {NL} order by seg) as text from kept group by doc) k using (doc)
)"""
contents(
    "c3_filter_fallback",
    f"select c.doc, md5(case when right(c.doc, 1) = '1' then 'no marker here' when f.text = '' and c.text <> '' then c.text else f.text end) as text_md5, case when right(c.doc, 1) = '1' or (f.text = '' and c.text <> '') then {listed()} else {listed(PIN_TABLE)} end as tables from content_text c join filtered f using (doc)",
    FILTERED,
)
add("c4_pin_tables", f"select doc_id, table_index, {PIN_TABLE} as is_pin_table from tabs", "v_page_tables", more=TABS)
add("c5_pin_sections", f"select doc_id, {section('text')} as is_section from v_pages", "v_pages")
add("c6_filter_tables", f"select doc_id, table_index from tabs where {PIN_TABLE}", "v_page_tables", more=TABS)
MARKED = segments("v_marked_text", "id")
add("c7_segments", "select id, cast(row_number() over (partition by id order by seg) - 1 as int) as pos, page, md5(text) as text_md5 from blocks", "v_marked_text", more=MARKED)
MARKED_KEPT = MARKED + f", kept as (select * from blocks b where page = id % 3 or {section('b.text')} or {any_of('lower(b.text)', rules.STRONG_HEADINGS)})"
add("c8_block_filter", "select v.id, coalesce(string_agg(k.page::varchar, ',' order by k.seg), '') as pages from v_marked_text v left join kept k on k.id = v.id group by v.id", "v_marked_text", more=MARKED_KEPT)
add("c9_reassemble", f"select v.id, md5(coalesce(string_agg('--- Page ' || k.page || ' ---' || {NL} || k.text, {NL} || {NL} order by k.seg), '')) as text_md5 from v_marked_text v left join kept k on k.id = v.id group by v.id", "v_marked_text", more=MARKED_KEPT)
contents("c10_pages_kept", "select doc, pages from content_text")
contents("c11_filter_content", f"select c.doc, md5(f.text) as text_md5, {listed(PIN_TABLE)} as tables, {IMAGE_COUNT} as n_images from content_text c join filtered f using (doc)", FILTERED)
row_text = lambda r: f"'| ' || array_to_string(list_transform({r}, lambda c: coalesce(c, 'None')), ' | ') || ' |'"
TABLE_LINES = f"""table_lines as (
  select doc, page, table_index, len(cells) as n, {NL} || 'Table from page ' || page || ':' as title, {row_text("cells[1]")} as head,
         list_transform(cells[1:15], lambda r: {row_text("r")}) as fifteen, list_transform(cells[2:12], lambda r: {row_text("r")}) as eleven from own_tables
), full_tables as (
  select doc, string_agg(array_to_string(list_concat([title, head], fifteen, case when n > 15 then ['| ... (truncated)'] else [] end), {NL}), {NL} order by page, table_index) as t from table_lines group by doc
), short_tables as (
  select doc, string_agg(array_to_string(list_concat([title, head], eleven, ['']), {NL}), {NL} order by page, table_index) as t from table_lines group by doc
)"""
contents(
    "c12_prompt_full",
    f"""select c.doc, md5(array_to_string(list_concat(
      ['Relevant pages: ' || replace(c.pages, ',', ', ') || {NL}], case when c.text <> '' then ['--- Pinout Information ---' || {NL}, c.text, ''] else [] end,
      case when t.t is not null then [{NL} || '--- Pinout Tables ---' || {NL}, t.t] else [] end,
      case when i.n_images > 0 then [{NL} || '--- Note ---' || {NL}, 'This content includes ' || i.n_images || ' diagram image(s). Use these for visual reference of pinout diagrams.'] else [] end), {NL})) as prompt_md5
    from content_text c left join full_tables t using (doc) left join own_images i using (doc)""",
    TABLE_LINES,
)
contents(
    "c13_prompt_short",
    f"""select c.doc, md5(array_to_string(list_concat(
      ['Relevant pages: ' || replace(c.pages, ',', ', ') || {NL}], case when c.text <> '' then ['--- Pinout Information ---' || {NL}, c.text, ''] else [] end,
      case when t.t is not null then ['--- Pinout Tables ---' || {NL}, t.t] else [] end), {NL})) as prompt_md5
    from content_text c left join short_tables t using (doc)""",
    TABLE_LINES,
)
add("c14_candidate_tables", f"select doc_id, table_index, {any_of('head_none', rules.CANDIDATE_TABLE_WORDS)} as is_candidate from tabs", "v_page_tables", more=TABS)

# --- model input and output
NAMED_PART = f"case when doc_id % 2 = 0 then {lit(responses.PART_BEFORE)} || doc || {lit(responses.PART_AFTER)} else '' end"
add("d1_pin_prompt", f"select doc_id, 'system,user' as roles, {lit(responses.PIN_SYSTEM)} as system, md5({asked('text', NAMED_PART)}) as asked_md5 from v_pages", "v_pages")
add("d7c_verification_prompt", f"select doc_id, 'system,user' as roles, {lit(responses.VERIFY_SYSTEM)} as system, md5({lit(responses.VERIFY_ASK)} || text) as asked_md5 from v_pages", "v_pages")
contents("d2_extract_pins", "select doc, 'stub' as component_name, 'DIP' as type, cast(0 as int) as n_pins, cast(null as varchar) as error from content_text")
PARSED = f"""raw as (
  select comp_id, case when json_valid({unfenced("response")}) then {unfenced("response")}::json end as j from v_llm_responses
), typed as (
  select *, json_type(j, '$.package') as pt, json_type(j, '$.pins') as nt from raw
), pins as (
  select comp_id, pos, p, json_type(p, '$.number') as kind from (select comp_id, unnest(json_extract(j, '$.pins[*]')) as p, generate_subscripts(json_extract(j, '$.pins[*]'), 1) - 1 as pos from typed where nt = 'ARRAY') t
), numbered as (
  select *, case when kind = 'VARCHAR' then coalesce(try_cast(nullif(regexp_extract(p->>'$.number', '\\d+'), '') as bigint), 0) when kind in ('BIGINT', 'UBIGINT') then cast(p->>'$.number' as bigint) end as number from pins
), judged as (
  select t.*, case when j is null then 'not JSON' when pt is not null and pt <> 'OBJECT' then 'package'
                   when exists (select 1 from numbered n where n.comp_id = t.comp_id and n.number is null) then 'pins' end as error from typed t
)"""
parsed = lambda name, body: add(name, body, "v_llm_responses", more=PARSED)
field = lambda path, missing: f"case when json_type(j, '{path}') is null then {missing} else j->>'{path}' end"
parsed(
    "d3_parse_pins",
    f"""select comp_id, case when error is null then {field("$.component_name", "'Unknown'")} end as component_name, case when error is null then {field("$.package.type", "'Unknown'")} end as type,
       case when error is null then cast({field("$.package.pin_count", "'0'")} as int) end as pin_count, case when error is null then coalesce(cast(j->>'$.package.width' as double), 0) end as width,
       case when error is null then coalesce(cast(j->>'$.package.height' as double), 0) end as height, case when error is null then cast(j->>'$.package.pitch' as double) end as pitch,
       case when error is null then {field("$.extraction_method", "'Unknown'")} end as extraction_method, case when error is null then cast(json_array_length(j, '$.pins') as int) end as n_pins, error is not null as failed from judged""",
)
parsed("d4_pin_numbers", "select n.comp_id, cast(n.pos as int) as pos, n.number, case when json_type(p, '$.name') is null then '' else p->>'$.name' end as name, p->>'$.function' as function from numbered n join judged g using (comp_id) where g.error is null")
parsed("d5_missing_or_null", f"select comp_id, error, case when error is null then {field('$.extraction_method', chr(39) + 'Unknown' + chr(39))} end as method from judged")
ANSWERS = "answers as (select doc_id, case doc_id % 4 when 0 then 'YES it does' when 1 then ' no, it doesn''t' when 2 then 'hard to say' end as answer from v_pages)"
says_yes = f"coalesce(not (upper({strip('answer')}) like 'NO%'), true)"
scored("d6_verify_pages", f"""select doc_id, case when mark then 5 else score end as score, cast(len(reasons) + mark::int as int) as n_reasons
from (select s.*, a.answer, unusual or (score >= 3 and score < 5) as mark from scored s left join answers a using (doc_id)) t where not mark or {says_yes}""", ANSWERS)  # fmt: skip
add("d7_says_yes", f"select conv_id, turn, {says_yes} as yes from v_verifications", "v_verifications")
add("d7b_verify_one_page", f"select doc_id, {says_yes} as yes from answers", "v_pages", more=ANSWERS)
add("d7d_sample_prompt", f"select doc, md5(string_agg('--- Page ' || page_number || ' ---' || {NL} || text, {NL} || {NL} order by page_number)) as samples_md5, 'use_all_candidates' as recommendation from v_pages where page_number <= 2 group by doc", "v_pages")
found = lambda t: f"coalesce(nullif(regexp_extract({t}, '```(?:json)?\\s*\\n?(\\{{.*?\\}})\\n?```', 1, 's'), ''), nullif(regexp_extract({t}, '\\{{.*\\}}', 0, 's'), ''))"
VISION = f"""r as (select id, response::json as j from v_vision_raw), picked as (
  select id, j, case when json_type(j, '$.description') = 'OBJECT' then json_extract(j, '$.description')
                  when json_type(j, '$.description') = 'VARCHAR' then try_cast({found("(j->>'$.description')")} as json)
                  when json_type(j, '$.raw_text') = 'VARCHAR' then try_cast({found("(j->>'$.raw_text')")} as json)
                  when json_type(j, '$.component_name') is not null or json_type(j, '$.package_type') is not null then j end as v from r
), results as (
  select id, coalesce(v->>'$.component_name', '') as component_name, coalesce(v->>'$.package_type', '') as package_type, coalesce(cast(v->>'$.pin_count' as int), 0) as pin_count,
         coalesce('[' || (select string_agg('{{"name":' || cast(json_extract(x, '$.name') as varchar) || ',"number":' || cast(json_extract(x, '$.number') as varchar) || '}}', ',') from (select unnest(json_extract(v, '$.pins[*]')) as x) y) || ']', '[]') as pins, coalesce(cast(v->>'$.extraction_confidence' as double), 0) as confidence, v is null or coalesce(v->>'$.notes', '') <> '' as has_note from picked
)"""
add("d8_vision_parse", "select * from results", "v_vision_raw", more=VISION)
best = lambda source: f"(select distinct doc from {source}) d left join (select *, row_number() over (partition by doc order by confidence desc, ord) as k from {source} where confidence > 0) b on b.doc = d.doc and b.k = 1"
add("d9_best_of_images", f"select d.doc, b.ord, coalesce(b.confidence, 0) as confidence, coalesce(b.component_name, '') as component_name from {best('v_vision_results')}", "v_vision_results")
add("a7_first_maximum", f"select d.doc, b.ord from {best('v_vision_results')}", "v_vision_results")
add("flow_c_vision", f"select d.doc, b.ord, coalesce(b.confidence, 0) as confidence, coalesce(b.component_name, '') as component_name from {best('named')}", "v_vision_raw", more=VISION + ", named as (select id % 50 as doc, id as ord, confidence, component_name from results)")
add("d10_vision_prompt", "select comp_id, case when comp_id % 3 = 2 then component_name else 'none' end as target from v_components", "v_components")
add("d11_layout_as_coded", "select id, 'Unknown' as package_type, coalesce(try_cast(nullif(regexp_extract(lower(text), 'pin count\\s*(\\d+)', 1), '') as int), 0) as pin_count, '' as sections from v_layout_text", "v_layout_text")
LAYOUT = f"""lines as (
  select id, u.pos, u.line from (select id, string_split(text, {NL}) as l from v_layout_text) s, lateral (select unnest(l) as line, generate_subscripts(l, 1) as pos) u
), named as (
  select id, pos, {strip("split_part(line, ':', 1)")} as section, regexp_replace(line, '^[^:]*:', '') as rest from lines
  where regexp_matches(line, '^\\s*[A-Za-z][A-Za-z _-]*:.*\\d') and not regexp_matches(lower(line), '^\\s*(package type|pin count)\\s*:')
), pieces as (
  select id, pos, section, u.k, u.piece from (select *, string_split(rest, ',') as l from named) s, lateral (select unnest(l) as piece, generate_subscripts(l, 1) as k) u
), numbers as (
  select id, pos, section, k, unnest(case when regexp_matches(piece, '\\d+\\s*-\\s*\\d+') then range(cast(regexp_extract(piece, '(\\d+)\\s*-\\s*(\\d+)', 1) as bigint), cast(regexp_extract(piece, '(\\d+)\\s*-\\s*(\\d+)', 2) as bigint) + 1)
         else list_transform(regexp_extract_all(piece, '\\d+'), lambda x: cast(x as bigint)) end) as number from pieces
), firsts as (
  select id, pos, section, number, min(k * 100000 + number) as ord from numbers group by id, pos, section, number
), joined as (
  select id, pos, section || '=' || string_agg(number::varchar, ',' order by ord) as s from firsts group by id, pos, section
)"""
add(
    "d11_layout_intended",
    f"""select v.id, coalesce({first([(f"contains(lower(text), {lit(w.lower())})", lit(k)) for k, ws in rules.LAYOUT_PACKAGES for w in ws])}, 'Unknown') as package_type,
       coalesce(try_cast(nullif(regexp_extract(lower(text), 'pin count\\s*:?\\s*(\\d+)', 1), '') as int), 0) as pin_count,
       coalesce((select string_agg(s, ';' order by pos) from joined j where j.id = v.id), '') as sections from v_layout_text v""",
    "v_layout_text",
    more=LAYOUT,
)
KNOWN = "known(known_at, known, known_pins, names) as (values " + ", ".join(f"({i}, {lit(k)}, {n}, [{', '.join(map(lit, names))}])" for i, (k, n, names) in enumerate(rules.KNOWN_PINOUTS)) + ")"
add(
    "d12_known_pinouts",
    """select f.comp_id, f.known, case when f.known is not null then (case when pin_count <> known_pins then 1 else 0 end) + (select count(*) from missing m where m.comp_id = f.comp_id) = 0 end as valid,
       case when f.known is null then 'not known' else concat_ws('; ', case when pin_count <> known_pins then 'pins ' || pin_count || ' not ' || known_pins end, (select string_agg('missing ' || name, '; ' order by pos) from missing m where m.comp_id = f.comp_id)) end as issues from firsts f""",
    "v_components",
    more=KNOWN + """, named as (select *, case comp_id % 4 when 0 then 'ne555-' || component_name when 1 then 'ATMEGA164A' else component_name end as shown from v_components
), firsts as (select c.comp_id, c.pin_count, k.* from named c left join known k on contains(lower(c.shown), lower(k.known))
), owned as (select comp_id, 'VCC' as name from v_components union all select comp_id, 'RESET' from v_components union all select comp_id, 'GND' from v_components where comp_id % 8 < 4
), missing as (select * from (select comp_id, unnest(names) as name, generate_subscripts(names, 1) as pos from firsts where known is not null) w where not exists (select 1 from owned s where s.comp_id = w.comp_id and s.name = w.name))""",
)
add("d13_cache_misses", "select comp_id from v_components where comp_id % 3 <> 0", "v_components")
add("d14_part_number", "select file_id, nullif(regexp_extract(regexp_replace(path, '\\.[^.]*$', ''), '^[A-Z0-9-]+'), '') as part from v_files", "v_files")

# --- packages
from_text = lambda t: first([("(" + " or ".join(f"regexp_matches(lower({t}), {lit(p)})" for p in ps) + ")", lit(k)) for k, ps in rules.PACKAGE_PATTERNS])
normalized = lambda t: f"coalesce({first([(f'contains({strip(f'upper({t})')}, {lit(a)})', lit(k)) for a, k in rules.NAME_ALIASES])}, {from_text(t)}, {strip(f'upper({t})')})"
SQUARE = "(width <> 0 and height <> 0 and greatest(width, height) / least(width, height) <= 1.3::double)"
IN = lambda ns: "pin_count in (" + ", ".join(map(str, ns)) + ")"
BY_LAYOUT = first([(f"{SQUARE} and {IN(rules.QFN_PINS)}", "'QFN'"), (f"pin_count % 2 = 0 and width > height * 1.5::double and {IN(rules.DIP_PINS)}", "'DIP'"), (f"width > height and {IN(rules.SOIC_PINS)} and width < 10 and height < 20", "'SOIC'"), (f"width > height and {IN(rules.TSSOP_PINS)} and width < 8 and height < 15", "'TSSOP'")])
DEFAULT = "case when pin_count <= 20 then 'SOIC' when pin_count <= 28 and pin_count % 2 = 0 then 'DIP' when pin_count <= 28 then 'SOIC' else 'QFN' end"
DIMS = "dims(kind, lo, hi, min_w, max_w, min_h, max_h) as (values " + ", ".join(f"({lit(d[0])}, {d[1]}, {d[2]}, " + ", ".join(f"{x}::double" for x in d[3:]) + ")" for d in rules.DIMENSIONS) + ")"
TYPED = DIMS + f", typed as (select *, {normalized('pkg_raw')} as kind from v_components), expected as (select t.*, d.min_w, d.max_w, d.min_h, d.max_h from typed t left join dims d on d.kind = t.kind and t.pin_count between d.lo and d.hi)"
component = lambda name, column, alias: add(name, f"select comp_id, {column} as {alias} from v_components", "v_components")
component("k1_detect_text", from_text("pkg_raw"), "type")
component("k2_normalize", normalized("pkg_raw"), "name")
component("k3_quasi_square", SQUARE, "square")
component("k4_detect_layout", BY_LAYOUT, "type")
add("k5_expected_dimensions", "select comp_id, kind, min_w, max_w, min_h, max_h from expected", "v_components", more=TYPED)
add("k6_validate", "select comp_id, coalesce(width between min_w and max_w and height between min_h and max_h, true) as valid from expected", "v_components", more=TYPED)
component("k7_default", DEFAULT, "type")
add(
    "k8_detect_package",
    f"""select c.comp_id, coalesce(case when c.up not in ('', 'UNKNOWN') and (d.kind is null or (c.width between d.min_w and d.max_w and c.height between d.min_h and d.max_h)) then c.up end,
       case when c.hint is not null and (e.kind is null or (c.width between e.min_w and e.max_w and c.height between e.min_h and e.max_h)) then c.hint end, c.laid, c.fallback) as type
    from named c left join dims d on d.kind = c.up and c.pin_count between d.lo and d.hi left join dims e on e.kind = c.hint and c.pin_count between e.lo and e.hi""",
    "v_components",
    more=DIMS + f", named as (select *, upper(pkg_raw) as up, {from_text('pkg_raw')} as hint, {BY_LAYOUT} as laid, {DEFAULT} as fallback from v_components)",
)
add(
    "k9_estimate",
    """select comp_id, coalesce((min_w + max_w) / 2, case kind when 'DIP' then 5.0::double + pin_count::double * 0.1::double when 'QFN' then 3.0::double + pin_count::double * 0.1::double else 5.0::double + pin_count::double * 0.05::double end) as width,
       coalesce((min_h + max_h) / 2, case when kind = 'DIP' then 10.0::double + pin_count::double * 0.2::double when kind = 'QFN' then 3.0::double + pin_count::double * 0.1::double when kind in ('SOIC', 'TSSOP') then 8.0::double + pin_count::double * 0.15::double else 8.0::double + pin_count::double * 0.05::double end) as height
    from expected""",
    "v_components",
    more=TYPED,
)
parsed_type = lambda t: f"coalesce({first([(f'{strip(f'upper({t})')} = {lit(a)}', lit(k)) for a, k in rules.TYPE_ALIASES])}, {first([(f'starts_with({strip(f'upper({t})')}, {lit(a)})', lit(k)) for a, k in rules.TYPE_ALIASES])}, 'DIP')"
component("k10_parse_type", parsed_type("pkg_raw"), "type")

# --- geometry, layout, join
GEO = f"geo(type, {', '.join(rules.GEOMETRY_COLUMNS)}) as (values " + ", ".join(f"({lit(g[0])}, " + ", ".join(f"{x}::double" for x in g[1:]) + ")" for g in rules.GEOMETRY) + ")"


def sized(source: str, package: str, pins: str) -> str:
    return GEO + f""", typed_parts as (select *, case when {parsed_type(package)} = 'LQFP' then 'TQFP' else {parsed_type(package)} end as type, cast({pins} as int) as n from {source}
), shared as (select t.*, g.* exclude (type), cast(case when t.type in ('DIP', 'SOIC') then n // 2 when t.type = 'BGA' then floor(sqrt(n::double)) else n // 4 end as int) as per_side from typed_parts t join geo g on g.type = t.type
), wide as (select *, case type when 'DIP' then 20.0::double when 'SOIC' then 5.0::double when 'TQFP' then 8.0::double + per_side * pitch when 'QFN' then 6.0::double + per_side * pitch else (per_side - 1) * pitch + 4.0::double end as body_width from shared
), sized as (select *, case type when 'DIP' then (per_side - 1) * pitch + 20.0::double when 'SOIC' then (per_side - 1) * pitch + 8.0::double else body_width end as body_height from wide)"""


SIZED = sized("v_components", "pkg_raw", "pin_count")
COLUMNS = "comp_id, type, n, per_side, pitch, body_width, body_height, top_margin, name_offset, num_offset"
for _number, _kind in enumerate(("DIP", "SOIC", "TQFP", "QFN", "BGA"), 1):
    add(f"g{_number}_{_kind.lower()}_parameters", f"select {COLUMNS} from sized where type = '{_kind}'", "v_components", more=SIZED)
add("g6_parameters", f"select {COLUMNS}, leg_length, leg_width, border_thickness, designator_offset from sized", "v_components", more=SIZED)
add(
    "g7_simple_position",
    """select comp_id, cast(i as int) as i,
       case when type = 'DIP' then (case when i < per_side then -body_width / 2 else body_width / 2 end)
            when type = 'TQFP' then (case when i < per_side then -body_width / 2 when i < per_side * 2 then -(body_width / 2) + top_margin + ((i - per_side) * pitch) when i < per_side * 3 then body_width / 2 else (body_width / 2) - top_margin - ((i - per_side * 3) * pitch) end) else 0 end as x,
       case when type = 'DIP' then (case when i < per_side then (body_height / 2) - top_margin - (i * pitch) else -(body_height / 2) + top_margin + ((i - per_side) * pitch) end)
            when type = 'TQFP' then (case when i < per_side then (body_height / 2) - top_margin - (i * pitch) when i < per_side * 2 then -body_height / 2 when i < per_side * 3 then -(body_height / 2) + top_margin + ((i - per_side * 2) * pitch) else body_height / 2 end) else 0 end as y,
       case when type = 'DIP' then (case when i < per_side then 'left' else 'right' end) when type = 'TQFP' then (case when i < per_side then 'left' when i < per_side * 2 then 'bottom' when i < per_side * 3 then 'right' else 'top' end) else 'left' end as side
    from (select *, unnest(range(0, n)) as i from sized) s""",
    "v_components",
    more=SIZED,
)


def around(inner: str, sign_left: str, sign_right: str) -> str:
    """Adds text and number places to `inner` (x, y, side and offsets)."""
    move = lambda off: (
        f"case side when 'left' then x {sign_left} {off} when 'right' then x {sign_right} {off} else x end",
        f"case side when 'top' then y + {off} when 'bottom' then y - {off} else y end",
    )
    align = "case side when 'left' then 'left' when 'right' then 'right' else 'center' end"
    (tx, ty), (nx, ny) = move("name_offset"), move("num_offset")
    return f"""select comp_id, kind, cast(pin_index as int) as pin_index, pin_number, x, y, side, case side when 'left' then 180::double when 'right' then 0::double when 'top' then 90::double else 270::double end as rotation,
       {tx} as text_x, {ty} as text_y, {align} as text_halign, {nx} as num_x, {ny} as num_y, {align} as num_halign from ({inner}) q"""


def placing(turned: bool = False) -> str:
    k = "i - 2 * per_side" if turned else "per_side - 1 - (i - 2 * per_side)"
    t = "i - 3 * per_side" if turned else "per_side - 1 - (i - 3 * per_side)"
    dip = """select *, i as pin_index, (i + 1)::varchar as pin_number, case when i < per_side then 'left' else 'right' end as side, case when i < per_side then -body_width / 2 else body_width / 2 end as x,
      (body_height / 2) - top_margin - ((case when i < per_side then i else per_side - 1 - (i - per_side) end) * pitch) as y from (select *, 'dip' as kind, unnest(range(0, 2 * per_side)) as i from sized where type in ('DIP', 'SOIC')) s"""
    quad = f"""select *, i as pin_index, (i + 1)::varchar as pin_number, case when i < per_side then 'left' when i < 2 * per_side then 'bottom' when i < 3 * per_side then 'right' else 'top' end as side,
      case when i < per_side then -body_width / 2 when i < 2 * per_side then -(body_width / 2) + top_margin + ((i - per_side) * pitch) when i < 3 * per_side then body_width / 2 else (body_width / 2) - top_margin - (({t}) * pitch) end as x,
      case when i < per_side then (body_height / 2) - top_margin - (i * pitch) when i < 2 * per_side then -body_height / 2 when i < 3 * per_side then -(body_height / 2) + top_margin + (({k}) * pitch) else body_height / 2 end as y
      from (select *, 'quad' as kind, unnest(range(0, 4 * per_side)) as i from sized where type in ('TQFP', 'QFN')) s"""
    bga = """select *, i as pin_index, (i + 1)::varchar as pin_number, case when pos < body_width then 'top' when pos < body_width + body_height then 'right' when pos < 2 * body_width + body_height then 'bottom' else 'left' end as side,
      case when pos < body_width then -body_width / 2 + pos when pos < body_width + body_height then body_width / 2 when pos < 2 * body_width + body_height then body_width / 2 - (pos - (body_width + body_height)) else -body_width / 2 end as x,
      case when pos < body_width then body_height / 2 when pos < body_width + body_height then body_height / 2 - (pos - body_width) when pos < 2 * body_width + body_height then -body_height / 2 else -body_height / 2 + (pos - (2 * body_width + body_height)) end as y
      from (select *, (i * (2 * (body_width + body_height))) / balls::double as pos from (select *, unnest(range(0, balls)) as i from (select *, 'bga' as kind, least(n, cast(floor(body_width + body_height) as int) * 2) as balls from sized where type = 'BGA') b) u) s"""
    return f"dip_rows as ({around(dip, '-', '+')}), quad_rows as ({around(quad, '+', '-')}), bga_rows as ({around(bga, '+', '-')}), places as (select * from dip_rows union all select * from quad_rows union all select * from bga_rows)"


LAID = SIZED + ", " + placing()
placed = lambda name, body, *views: add(name, body, "v_components", *views, more=LAID)
placed("l0_layout", "select * from places")
placed("l1_dip_layout", "select * from dip_rows")
placed("l2_quad_layout", "select * from quad_rows")
placed("l3_bga_layout", "select * from bga_rows")
add("l2_quad_layout_intended", "select * from quad_rows", "v_components", more=SIZED + ", " + placing(True))
SIDE = first([(f"contains(lower(section), '{w}')", f"'{w}'") for w in rules.SIDE_WORDS])


def custom(pins: str) -> str:
    inner = f"""select s.*, 'custom' as kind, c.pin::varchar as pin_number, c.side, c.pin_index,
      case c.side when 'left' then -body_width / 2 when 'right' then body_width / 2 else -(body_width / 2) + top_margin + (c.i * pitch) end as x,
      case c.side when 'left' then (body_height / 2) - top_margin - (c.i * pitch) when 'right' then (body_height / 2) - top_margin - (c.i * pitch) when 'bottom' then -body_height / 2 else body_height / 2 end as y
      from sized s join ({pins}) c on c.comp_id = s.comp_id"""
    return around(inner, "-", "+")


SECTION_PINS = f"select comp_id, first_pin + i as pin, i, side, row_number() over (partition by comp_id order by sec_pos, i) - 1 as pin_index from (select *, coalesce({SIDE}, 'left') as side, unnest(range(0, pins)) as i from v_custom_layout) t"
add("l4_custom_layout", custom(SECTION_PINS), "v_components", "v_custom_layout", more=SIZED)
add("l5_builder_pins", "select comp_id, number::varchar as pin_number, name from v_pins", "v_pins")
placed("j1_pin_join", "select p.comp_id, l.pin_number, p.name, l.pin_index, l.x, l.y, l.side from v_pins p join places l on l.comp_id = p.comp_id and l.pin_number = p.number::varchar", "v_pins")
placed("j1_unplaced_pins", "select comp_id, number::varchar as pin_number, name from v_pins p where not exists (select 1 from places l where l.comp_id = p.comp_id and l.pin_number = p.number::varchar)", "v_pins")
NONE = "cast(null as double)"
entry = lambda part, name, shape, x, y, w=NONE, h=NONE, d=NONE, label="cast(null as varchar)", size=NONE, align="cast(null as varchar)": f"'{part}' as part, {name} as name, '{shape}' as shape, {x} as x, {y} as y, {w} as width, {h} as height, {d} as depth, {label} as label, {size} as size, {align} as halign"
BORDERS = " union all ".join(
    f"select comp_id, {entry('BodyLine', f'{chr(39)}BodyLine_{s}{chr(39)}', 'box', x, y, w, h, 'border_height')} from sized"
    for s, x, y, w, h in (("Top", "0::double", "body_height / 2", "body_width", "border_thickness"), ("Bottom", "0::double", "-body_height / 2", "body_width", "border_thickness"), ("Left", "-body_width / 2", "0::double", "border_thickness", "body_height"), ("Right", "body_width / 2", "0::double", "border_thickness", "body_height"))
)
PRIMITIVES = " union all ".join(
    (
        f"select j.comp_id, {entry('Legs', 'j.pin_number || ' + lit('_leg'), 'box', 'j.x', 'j.y', 's.leg_length', 's.leg_width', 's.leg_thickness')} from joined j join sized s using (comp_id)",
        f"select j.comp_id, {entry('Legs', 'j.pin_number || ' + lit('_text'), 'text', 'j.text_x', 'j.text_y', d='s.name_height', label='left(j.name, 30)', size='s.name_size', align='j.text_halign')} from joined j join sized s using (comp_id) where coalesce(j.name, '') <> ''",
        f"select j.comp_id, {entry('Legs', 'j.pin_number || ' + lit('_num'), 'text', 'j.num_x', 'j.num_y', d='s.num_height', label='j.pin_number', size='s.num_size', align='j.num_halign')} from joined j join sized s using (comp_id)",
    )
)
LABELS = f"select comp_id, {entry('DesignatorName', lit('DesignatorName'), 'text', '0::double', 'body_height / 2 + designator_offset', d='0.5::double', label=lit('U'), size='designator_size')} from sized union all select comp_id, {entry('PackageValue', lit('PackageValue'), 'text', '0::double', 'body_height / 2 + value_offset', d='0.5::double', label='left(component_name, 30)', size='value_size')} from sized"
JOINED = "joined as (select l.*, p.name from v_pins p join places l on l.comp_id = p.comp_id and l.pin_number = p.number::varchar)"
add("b1_borders", BORDERS, "v_components", more=SIZED)
add("b2_pin_primitives", PRIMITIVES, "v_components", "v_pins", more=LAID + ", " + JOINED)
add("b3_labels", LABELS, "v_components", more=SIZED)
add("b4_assembly", f"select * from ({BORDERS} union all {PRIMITIVES} union all {LABELS}) u", "v_components", "v_pins", more=LAID + ", " + JOINED)
FLOW = (
    PARSED
    + f""", components as (select comp_id, coalesce({normalized("case when json_type(j, '$.package.type') is null then 'Unknown' else j->>'$.package.type' end")}, 'UNKNOWN') as package_name, coalesce(cast(j->>'$.package.pin_count' as int), 0) as pin_count,
  {field("$.component_name", "'Unknown'")} as component_name from judged where error is null
), """
    + sized("components", "package_name", "pin_count")
    + ", "
)
FLOW_PINS = "flow_pins as (select n.comp_id, n.number::varchar as pin_number, case when json_type(p, '$.name') is null then '' else p->>'$.name' end as name from numbered n join components using (comp_id))"
FLOW_JOIN = ", joined as (select l.*, p.name from flow_pins p join places l using (comp_id, pin_number))"
ASSEMBLY = f"({BORDERS} union all {PRIMITIVES} union all {LABELS})"
FLOW_PLAIN = FLOW + placing() + ", " + FLOW_PINS + FLOW_JOIN
add("b5_build", f"select comp_id, part, name, x, y, label from {ASSEMBLY} u", "v_llm_responses", more=FLOW_PLAIN)
add("s15_draw_rows", f"select comp_id, part, name, shape, width, height, depth, size, halign from {ASSEMBLY} u", "v_llm_responses", more=FLOW_PLAIN)
add("flow_a_drawing", f"select * from {ASSEMBLY} u", "v_llm_responses", more=FLOW_PLAIN)
FLOW_CUSTOM = FLOW + f"places as ({custom(SECTION_PINS)}), " + FLOW_PINS + FLOW_JOIN
add("flow_b_custom", f"select * from {ASSEMBLY} u", "v_llm_responses", "v_custom_layout", more=FLOW_CUSTOM)

# --- aggregation, sort, limit, union
add("a1_status_counts", "select status, count(*) as n from v_runs group by status", "v_runs")
add("a2_run_summary", f"select count(*) as total, count(*) filter (status = 'success') as successes, count(*) filter (status = 'no_pages') as no_pages, count(*) filter (status in ({', '.join(map(lit, rules.ERROR_STATUSES))})) as errors from v_runs", "v_runs")
add("a2_merged_runs", "select status, count(distinct run) as n_runs, count(*) as n, min(cost) as low, max(cost) as high, count(distinct item) as n_items from v_costed_runs group by status", "v_costed_runs")
add("a3_image_area_sum", "select doc_id, sum(width * height) as image_area from v_page_images group by doc_id", "v_page_images")
add("a4_predicate_hits", f"select doc_id, {matches('head_empty', rules.TABLE_PATTERNS)} as hits from tabs", "v_page_tables", more=TABS)
image("a5_any_large", "select doc_id, bool_or(is_large) as any_large from measured group by doc_id")
add("a6_ordered_text", "select doc, string_agg(page_number || ':' || length(text), ',' order by page_number) as lengths from v_pages group by doc", "v_pages")
add("a8_distinct_pages", f"select distinct doc, doc_id from tabs where {PIN_TABLE}", "v_page_tables", more=TABS)
add("a9_ordered_distinct", "select v.id, coalesce((select string_agg(x, ',' order by k) from (select x, min(k) as k from (select unnest(n) as x, generate_subscripts(n, 1) as k from (select regexp_extract_all(v.text, '\\d+') as n) e) u group by x) g), '') as numbers from v_layout_text v", "v_layout_text")
add("a10_group_lists", f"select comp_id, side, string_agg(section, ',' order by sec_pos) as sections from (select *, coalesce({SIDE}, 'left') as side from v_custom_layout) t group by comp_id, side", "v_custom_layout")
scored("o1_sort_score", "select doc, cast(rank as int) as rank, page_number from scored where score >= 5")
scored("o2_sort_page", "select doc, page_number from scored where score >= 5")
add("o3_first_lines", f"select doc_id, cast(len(string_split(text, {NL})[1:10]) as int) as n_lines, md5(left(text, 30)) as head_md5 from v_pages", "v_pages")
scored("o4_best_page", "select doc, page_number, score from scored where score >= 5 and rank = 1")
add("o5_first_ten", "select comp_id, string_agg(number || ':' || name, ',' order by number, name) as pins from (select *, row_number() over (partition by comp_id order by number, name) as k from v_pins) t where k <= 10 group by comp_id", "v_pins")
add("u1_union", "select doc_id, 'table' as kind, table_index as at from v_page_tables union all select doc_id, 'image', image_index from v_page_images", "v_page_tables", "v_page_images")
LINES = "(select string_agg('Pin ' || coalesce(number::varchar, 'None') || ': ' || (case when json_type(p, '$.name') is null then '' else p->>'$.name' end) || case when coalesce(p->>'$.function', '') <> '' then ' (' || (p->>'$.function') || ')' else '' end, chr(10) order by pos) from numbered n where n.comp_id = g.comp_id)"
REPORT = f"""concat_ws({NL}, repeat('=', 70), 'Component: ' || ({field("$.component_name", "'Unknown'")}), 'Package: ' || ({field("$.package.type", "'Unknown'")}) || '-' || ({field("$.package.pin_count", "'0'")}),
       'Dimensions: ' || coalesce(j->>'$.package.width', '0') || 'mm x ' || coalesce(j->>'$.package.height', '0') || 'mm', 'Pitch: ' || coalesce(j->>'$.package.pitch', 'None'), repeat('=', 70), '', 'Total Pins: ' || json_array_length(j, '$.pins'), '', {LINES})"""
parsed("f7_report", f"select comp_id, md5({REPORT}) as report_md5 from judged g where error is null")
parsed("s16_console_report", f"select comp_id, cast(u.k - 1 as int) as line_at, u.line from (select comp_id, string_split({REPORT}, {NL}) as l from judged g where error is null) r, lateral (select unnest(r.l) as line, generate_subscripts(r.l, 1) as k) u")
contents("flow_a_text", "select c.doc, md5(case when f.text = '' and c.text <> '' then c.text else f.text end) as text_md5, 2 as n_messages from content_text c join filtered f using (doc)", FILTERED)

# --- batches
BATCH = f"""v_pages as (select * from v_batch_pages), {SCORED}, {PARSED}, outcome as (
  select b.doc, case when j.comp_id is null or j.error is not null then 'llm_error' else 'success' end as status,
         case when j.comp_id is null then 'not JSON' else j.error end as error, j.comp_id
  from (select distinct doc from scored where score >= 5) b left join judged j on 'd' || j.comp_id = b.doc
  union all select doc, 'no_pages', null, null from (select distinct doc from v_batch_pages) a where doc not in (select doc from scored where score >= 5)
  union all select doc, 'error', error, null from v_undecoded)"""
BATCH_VIEWS = ("v_batch_pages", "v_page_tables", "v_page_images", "v_llm_responses", "v_undecoded")
add(
    "flow_e_batch_totals",
    f"select count(*) as total, count(*) filter (status = 'success') as successes, count(*) filter (status = 'no_pages') as no_pages, count(*) filter (status in ({', '.join(map(lit, rules.ERROR_STATUSES))})) as errors from outcome",
    *BATCH_VIEWS,
    more=BATCH,
)
fine = lambda column: f"case when o.status = 'success' then {column} end"
add(
    "flow_e_batch",
    f"""select o.doc, o.status, o.error, {fine(field("$.component_name", "'Unknown'"))} as component_name, {fine(field("$.package.type", "'Unknown'"))} as package_type,
       cast({fine(field("$.package.pin_count", "'0'"))} as int) as pin_count, cast({fine("json_array_length(j, '$.pins')")} as int) as n_pins
from outcome o left join judged using (comp_id)""",
    *BATCH_VIEWS,
    more=BATCH,
)
CHOSEN = """doubtful as (select *, unusual or (score >= 3 and score < 5) as mark from scored
), confirmed as (select doc, doc_id, page_number, case when mark then 5 else score end as score from doubtful where not mark or doc_id % 3 <> 1
), chosen as (select * from confirmed c where score >= 5 or (score >= 3 and not exists (select 1 from confirmed o where o.doc = c.doc and o.score >= 5)))"""
CHOOSING = f"v_pages as (select * from v_batch_pages), {SCORED}, {CHOSEN}"
add("flow_d_chosen_pages", "select doc, page_number, score from chosen", "v_batch_pages", "v_page_tables", "v_page_images", more=CHOOSING)
# What the picture of a document shows: its sections' numbers, in their order, by side; a later mention of a pin counts.
PICTURED = LAYOUT.replace("from v_layout_text)", "from pictures)").replace("joined as (", "section_texts as (") + f""", pictured as (
  select id as comp_id, number as pin, {SIDE} as side, row_number() over (partition by id, pos order by ord) - 1 as i, row_number() over (partition by id order by pos, ord) - 1 as pin_index from firsts
)"""
LAID_BY_PICTURE = (
    FLOW
    + "pictures as (select id, text from v_layout_text where id % 4 <> 2), "
    + PICTURED
    + ", drawn as ("
    + custom("select * from pictured")
    + "), "
    + placing().replace("places as (", "standard as (")
    + """, places as (select * from drawn qualify row_number() over (partition by comp_id, pin_number order by pin_index desc) = 1
  union all select * from standard where comp_id not in (select comp_id from pictured)), """
    + FLOW_PINS
    + FLOW_JOIN
)
add(
    "flow_d_layout",
    f"select 'd' || comp_id as comp_id, u.* exclude (comp_id) from {ASSEMBLY} u where 'd' || comp_id in (select doc from chosen)",
    "v_batch_pages",
    "v_page_tables",
    "v_page_images",
    "v_llm_responses",
    "v_layout_text",
    more=f"{CHOOSING.replace('parts as (', 'page_parts as (').replace('from parts', 'from page_parts')}, {LAID_BY_PICTURE}",
)
add(
    "s1_page_ranges",
    """select doc_id, cast(k as int) as page_number, cast(len(p) as int) as total_pages, cast(strlen(p[k]) as bigint) as n_bytes, md5(p[k]) as text_md5
from (select doc_id, p, unnest(range(1, len(p) + 1)) as k from (select doc_id, string_split(text, chr(10)) as p from documents where text is not null) x) y""",
)
add("s11_committed_files", "select regexp_replace(source, '[^\\w.-]+', '_', 'g') || '/' || doc_id || '.txt' as name, cast(strlen(text) as bigint) as n_bytes, sha256(text) as sha256 from documents where text is not null")

# --- joins with tables of any size
add(
    "k5_part_ranges",
    """select c.comp_id, p.p_partkey as range_id from v_components c join part p on floor(p.p_partkey / 50) = floor(c.comp_id / 50)
     and c.pin_count between p.p_size - 5 and case when p.p_partkey % 17 <> 0 then p.p_size + p.p_partkey % 40 else 1000000 end""",
    "v_components",
)
add(
    "d12_known_parts",
    """select p_partkey, p_name, known, known_id from (
    select p.p_partkey, p.p_name, k.known, k.known_id, row_number() over (partition by p.p_partkey order by length(k.known) desc, k.known_id) as r
    from part p left join (select substr(p_name, 1, cast(3 + p_partkey % 9 as int)) as known, p_partkey as known_id from part) k on starts_with(p.p_name, k.known)) x where r = 1""",
)
add(
    "p6_many_keywords",
    """select doc_id, count(*) as n_keywords, cast(sum(n) as bigint) as n_hits from (
    select doc_id, (length(low) - length(replace(low, keyword, ''))) // length(keyword) as n from (select doc_id, lower(text) as low from documents) d,
        (select distinct w[i] || case when i % 4 = 0 then ' ' || w[i + 1] else '' end as keyword from (
            select w, unnest(range(2, len(w), 2)) as i from (select regexp_split_to_array(lower(text), '[^a-z]+') as w from benchmark) b where len(w) >= 3) s) k where keyword <> '') x
where n > 0 group by doc_id""",
)

# --- streams: what the last revisions are
add(
    "p10_streamed_ranks",
    """select doc, page_number, cast(score as int) as score, cast(r as int) as rank from (select *, row_number() over (partition by doc order by score desc, page_number) as r from scored where score >= 5) x where r <= 3""",
    *BATCH_VIEWS,
    more=f"v_pages as (select * from v_batch_pages), {SCORED}",
)

# --- through SQL functions
for _name in ("p8_page_score", "k2_normalize", "c7_segments"):
    ORACLES[f"{_name}_sql"] = ORACLES[_name]
