"""Logical tables laid over plain ones, each one SQL text that Spark and DuckDB both run.

Where the common text joins by an inequality, Spark has a text of its own that generates the rows instead, so it plans no
nested loop. The texts name their inputs in braces. `frame` gives a DataFrame, `ctes` the same as common table expressions.
"""

from __future__ import annotations

from string import Formatter

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS: dict[str, str] = {
    # Pages without their numbers, and the numbers: the engine looks at text where it lies, and numbers narrow rows.
    "v_page_text": """select source as doc, doc_id,
       case doc_id % 10
         when 0 then concat('Pin Configuration', chr(10), text)
         when 3 then concat('Package drawing', chr(10), text)
         when 5 then concat('Figure 1-1. Pinout', chr(10), text)
         when 7 then concat(text, chr(10), 'ordering information')
         else text end as text
from {documents}""",
    # Pages of a batch of many documents, eight pages each, which carry their numbers; some documents can't be decoded.
    "v_batch_pages": """select concat('d', cast(cast(floor(doc_id / 8) as bigint) as varchar(20))) as doc, doc_id, cast(doc_id % 8 + 1 as int) as page_number, cast(8 as bigint) as total_pages,
       cast(612 as double) as width, cast(792 as double) as height, text
from {v_page_text} where cast(floor(doc_id / 8) as bigint) % 13 <> 5""",
    "v_undecoded": """select distinct concat('d', cast(cast(floor(doc_id / 8) as bigint) as varchar(20))) as doc, 'no pages in it' as error
from {documents} where cast(floor(doc_id / 8) as bigint) % 13 = 5""",
    "v_batch_answers": """select concat('d', cast(comp_id as varchar(20))) as doc, response from {v_llm_responses}""",
    # Layout answers: JSON whose description is fenced or isn't, plain text, and failed calls.
    "v_batch_layouts": """select concat('d', cast(id as varchar(20))) as doc,
       case id % 4 when 0 then concat('{{"description": "```', chr(92), 'n', replace(text, chr(10), concat(chr(92), 'n')), '```"}}')
            when 1 then text when 2 then cast(null as varchar(10))
            else concat('{{"description": "', replace(text, chr(10), concat(chr(92), 'n')), '"}}') end as response
from {v_layout_text}""",
    "v_page_numbers": """select source as doc, doc_id,
       cast(row_number() over (partition by source order by doc_id) as int) as page_number,
       count(*) over (partition by source) as total_pages,
       cast(612 as double) as width, cast(792 as double) as height
from {documents}""",
    "v_pages": """select source as doc, doc_id,
       cast(row_number() over (partition by source order by doc_id) as int) as page_number,
       count(*) over (partition by source) as total_pages,
       cast(612 as double) as width, cast(792 as double) as height,
       case doc_id % 10
         when 0 then concat('Pin Configuration', chr(10), text)
         when 3 then concat('Package drawing', chr(10), text)
         when 5 then concat('Figure 1-1. Pinout', chr(10), text)
         when 7 then concat(text, chr(10), 'ordering information')
         else text end as text
from {documents}""",
    "v_page_tables": """select doc_id, source as doc, cast(0 as int) as table_index, cast(1 + doc_id % 20 as int) as n_rows,
       case doc_id % 6 when 0 then 'Pin No.|Pin Name|Function' when 1 then 'Symbol|Description'
            when 2 then 'Parameter|Min|Max' when 3 then 'Function'
            when 4 then 'Crystal XTAL|Value' else 'Signal Name||Pin Number' end as header
from {documents} where doc_id % 4 in (0, 1)""",
    "v_page_images": """select d.doc_id, d.source as doc, x.image_index,
       cast(60 + (d.doc_id * 37) % 500 as double) as width,
       cast(80 + (d.doc_id * 53 + x.image_index * 11) % 600 as double) as height
from {documents} d
join (select cast(0 as int) as image_index union all select 1 union all select 2) x
  on x.image_index < d.doc_id % 4""",
    "v_components": """select p_partkey as comp_id, concat(p_name, ' ', p_brand) as component_name,
       case p_partkey % 12 when 0 then 'PDIP-40' when 1 then 'soic-16' when 2 then 'TSSOP-20'
            when 3 then 'LQFP64' when 4 then 'TQFP-44' when 5 then 'VQFN' when 6 then 'LFBGA'
            when 7 then 'Unknown' when 8 then 'DIL' when 9 then 'LGA' when 10 then case when p_partkey % 24 = 10 then 'dip 8' else concat('QFN-', cast(16 + 4 * (p_partkey % 9) as varchar(10))) end
            else 'SOT-23' end as pkg_raw,
       cast(4 + (p_partkey * 7 + p_size) % 97 as int) as pin_count,
       cast(3 + p_partkey % 15 as double) as width,
       cast(4 + (p_partkey * 3 + p_size) % 18 as double) as height
from {part}""",
    "v_numbers": """select distinct cast(l_quantity as int) + 50 * k as n
from {lineitem} cross join (select 0 as k union all select 1 union all select 2) x""",
    "v_pins": """select c.comp_id, cast(x.n as bigint) as number,
       case when x.n % 17 = 0 then '' else concat('P', cast(x.n as varchar(10))) end as name,
       case x.n % 4 when 0 then 'power' when 1 then 'ground' when 2 then 'input' end as function
from {v_components} c join {v_numbers} x on x.n <= c.pin_count + 1 and x.n % 11 <> 0
union all
select comp_id, cast(1 as bigint), 'DUP', cast(null as varchar(10)) from {v_components} where comp_id % 5 = 0""",
    "v_llm_responses": """select comp_id,
       case comp_id % 8
         when 0 then concat('```json', chr(10), body, chr(10), '```')
         when 1 then concat('```', chr(10), body, '```')
         when 2 then replace(body, '"number": 1,', '"number": "Pin 1",')
         when 3 then replace(body, '"number": 1,', '"number": "A1",')
         when 4 then replace(body, '"number": 1,', '"number": null,')
         when 5 then '{{"component_name": "X", "package": null, "pins": []}}'
         when 6 then substring(body, 1, 40)
         else body end as response
from (select comp_id, concat('{{"component_name": "', component_name, '", "package": {{"type": "', pkg_raw,
        '", "pin_count": ', cast(pin_count as varchar(10)), ', "width": ', case when comp_id % 3 = 0 then 'null' else cast(cast(width as int) as varchar(10)) end,
        ', "height": null, "pitch": null}}, "pins": [{{"number": 1, "name": "VCC", "function": "power"}}, {{"number": 2, "name": "GND"}}]}}') as body
      from {v_components}) b""",
    "v_verifications": """select conv_id, turn,
       case (conv_id + turn) % 6 when 0 then concat('Yes. ', text) when 1 then concat('  NO, ', text)
            when 2 then 'NOT SURE' when 3 then text when 4 then cast(null as varchar(10)) else 'YES' end as answer
from {conversations} where role = 'assistant'""",
    "v_vision_results": """select user_id as doc, event_id as ord,
       cast(event_id % 11 as double) / cast(10 as double) as confidence,
       concat('part-', cast(event_id % 7 as varchar(10))) as component_name
from {events}""",
    "v_runs": """select event_id as run_id,
       case event_type when 'click' then 'success' when 'view' then 'no_pages' when 'error' then 'error'
            when 'signup' then 'extraction_error' else 'llm_error' end as status
from {events}""",
    "v_costed_runs": """select event_id % 10 as run, event_type as status, user_id as item, value as cost from {events}""",
    "v_layout_text": """select p_partkey as id,
       case p_partkey % 5
         when 0 then concat('Package Type: QFN', chr(10), 'Pin Count: ', cast(p_size as varchar(10)), chr(10), 'Left Side: 1,2,3', chr(10), 'Bottom Edge: 4-6', chr(10), 'Right Side: 9, 8, 9, 7', chr(10))
         when 1 then concat('package dip, pin count ', cast(p_size as varchar(10)), chr(10), 'Top: 10,11', chr(10))
         when 2 then concat('Thin Quad Flat; Pin Count 64', chr(10), 'Left Column: 1,2', chr(10), 'left column: 3', chr(10))
         when 3 then 'no layout here'
         else concat('Ball Grid Array', chr(10), 'Top Edge: Pin 1, Pin 2, Pin 2', chr(10)) end as text
from {part}""",
    "v_marked_text": """select doc_id as id,
       concat('junk', chr(10), '--- Page ', cast(doc_id % 7 as varchar(10)), ' ---', chr(10), text, chr(10), chr(10),
              '  --- Page x ---', chr(10), 'dropped', chr(10), '--- Page 90 ---', chr(10),
              case doc_id % 4 when 0 then 'Pinout - top view' when 1 then 'Pin Description ordering information'
                              when 2 then 'see (a1/b2/c3/t1) pb0 pa0 (x' else 'nothing' end,
              chr(10), '--- Page 91 ---', chr(10), '--- Page 92 ---', chr(10), 'tail') as text
from {documents}""",
    "v_vision_raw": """select id,
       case id % 6
         when 0 then concat('{{"description": ', body, '}}')
         when 1 then concat('{{"description": "```json', chr(92), 'n', replace(body, '"', concat(chr(92), '"')), chr(92), 'n```"}}')
         when 2 then concat('{{"raw_text": "Here: ', replace(body, '"', concat(chr(92), '"')), ' done"}}')
         when 3 then body
         when 4 then '{{"description": "nothing found"}}'
         else '{{"status": 1}}' end as response
from (select event_id as id, concat('{{"component_name": "part-', cast(event_id % 7 as varchar(10)), '", "package_type": "DIP-8", "pin_count": 8, "pins": [{{"number": 1, "name": "VCC"}}], "extraction_confidence": 0.', cast(event_id % 9 as varchar(10)), '}}') as body from {events}) b""",
    "v_files": """select c_custkey as file_id,
       case c_custkey % 4 when 0 then concat('STM32F', cast(c_custkey as varchar(20)), '.PDF') when 1 then concat('NE555-', cast(c_custkey as varchar(20)), ' datasheet.pdf')
            when 2 then concat('lower', cast(c_custkey as varchar(20)), '.pdf') else concat('README', cast(c_custkey as varchar(20)), '.txt') end as path
from {customer}""",
    "v_custom_layout": """select comp_id, component_name, pkg_raw, pin_count, s.sec_pos, s.section, s.first_pin, s.pins
from {v_components} c
join (select cast(0 as int) as sec_pos, 'Left_Side' as section, cast(1 as int) as first_pin, cast(3 as int) as pins
      union all select 1, 'bottom edge', 4, 2 union all select 2, 'RIGHT column', 6, 3 union all select 3, 'Top_edge', 9, 2
      union all select 4, 'middle', 11, 1) s on s.sec_pos <= c.comp_id % 6""",
}

SPARK_VIEWS: dict[str, str] = {
    "v_pages": "select t.doc, t.doc_id, n.page_number, n.total_pages, n.width, n.height, t.text from {v_page_text} t join {v_page_numbers} n on n.doc_id = t.doc_id",
    "v_page_images": """select d.doc_id, d.source as doc, image_index,
       cast(60 + (d.doc_id * 37) % 500 as double) as width,
       cast(80 + (d.doc_id * 53 + image_index * 11) % 600 as double) as height
from {documents} d lateral view explode(slice(array(0, 1, 2), 1, cast(d.doc_id % 4 as int))) x as image_index""",
    "v_numbers": "select distinct cast(l_quantity as int) + 50 * k as n from {lineitem} lateral view explode(array(0, 1, 2)) x as k",
    # 150 numbers at every scale
    "v_pins": """select /*+ broadcast(x) */ c.comp_id, cast(c.n as bigint) as number,
       case when c.n % 17 = 0 then '' else concat('P', cast(c.n as string)) end as name,
       case c.n % 4 when 0 then 'power' when 1 then 'ground' when 2 then 'input' end as function
from (select comp_id, explode(sequence(1, pin_count + 1)) as n from {v_components}) c left semi join {v_numbers} x on x.n = c.n
where c.n % 11 <> 0
union all
select comp_id, cast(1 as bigint), 'DUP', cast(null as string) from {v_components} where comp_id % 5 = 0""",
    "v_custom_layout": """select comp_id, component_name, pkg_raw, pin_count, s.sec_pos, s.section, s.first_pin, s.pins
from {v_components} lateral view explode(slice(array(
    named_struct('sec_pos', 0, 'section', 'Left_Side', 'first_pin', 1, 'pins', 3), named_struct('sec_pos', 1, 'section', 'bottom edge', 'first_pin', 4, 'pins', 2),
    named_struct('sec_pos', 2, 'section', 'RIGHT column', 'first_pin', 6, 'pins', 3), named_struct('sec_pos', 3, 'section', 'Top_edge', 'first_pin', 9, 'pins', 2),
    named_struct('sec_pos', 4, 'section', 'middle', 'first_pin', 11, 'pins', 1)), 1, cast(comp_id % 6 + 1 as int))) x as s""",
}


def inputs(text: str) -> list[str]:
    return list(dict.fromkeys(name for _, name, _, _ in Formatter().parse(text) if name))


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = SPARK_VIEWS.get(name, VIEWS[name])
    return spark.sql(text, **{x: frame(spark, sf_dir, x) for x in inputs(text)})


def ctes(*names: str) -> str:
    """`with a as (...), b as (...)` for these views and what they stand on."""
    order: list[str] = []

    def need(name: str) -> None:
        if name not in TABLES and name not in order:
            for x in inputs(VIEWS[name]):
                need(x)
            order.append(name)

    for name in names:
        need(name)
    return "with " + ",\n".join(f"{n} as ({VIEWS[n].format(**{x: x for x in inputs(VIEWS[n])})})" for n in order)
