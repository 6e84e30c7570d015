"""The operators as SQL functions: `register` puts them into the session, or into a schema of the catalogue for everyone.

Their bodies are SQL, which the optimiser takes into the query that calls them, so they run where built-in functions do and without
Python. Text is looked at by `lf_page_features` where it lies; what that gives is narrow and goes through joins:

    SELECT p.doc_id, s.score, s.reasons
    FROM (SELECT *, lf_page_features(text) AS f FROM pages) p,
      LATERAL lf_page_score(p.f, p.table_matches, p.image_share, p.page_number, p.total_pages, 5, 3) s
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import rules


FEATURES = "STRUCT<heading: STRING, caption: STRING, keywords: INT, words: INT, short: BOOLEAN>"


def text(value: str) -> str:
    """A literal that is taken as it stands, however the session reads escapes."""
    return "concat(" + ", char(39), ".join(f"r'{part}'" for part in value.split("'")) + ")" if "'" in value else f"r'{value}'"


def strip(x: str) -> str:
    return f"btrim({x}, concat(' ', char(9), char(10), char(13), char(12), char(11)))"


def first_match(x: str, patterns: list[str]) -> str:
    """The first pattern of the list that occurs in the text, or null."""
    return "CASE " + " ".join(f"WHEN rlike({x}, {text(p)}) THEN {text(p)}" for p in patterns) + " END" if patterns else "CAST(NULL AS STRING)"


def count_matches(x: str, patterns: list[str]) -> str:
    return " + ".join(["0", *(f"CAST(rlike({x}, {text(p)}) AS INT)" for p in patterns)])


def occurrences(x: str, words: list[str]) -> str:
    """Non-overlapping occurrences of the words as plain text."""
    return " + ".join(["0", *(f"(length({x}) - length(replace({x}, {text(w)}, ''))) DIV {len(w)}" for w in words)])


def first_contained(x: str, pairs: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN contains({x}, {text(k)}) THEN {text(v)}" for k, v in pairs) + " END"


def scalars(rule_set: rules.PageRules) -> dict[str, tuple[str, str, str]]:
    """Name: (parameters, type, expression)."""
    package = "CASE " + " ".join(f"WHEN rlike(lower(name), {text('|'.join(patterns))}) THEN {text(kind)}" for kind, patterns in rules.PACKAGE_PATTERNS) + " END"
    up = strip("upper(name)")
    yes = strip("upper(answer)")
    number = strip(f"replace(replace({strip('m.line')}, '--- Page', ''), '---', '')")
    blocks = f"""transform(array(split(content, char(10))), l -> transform(
      array(filter(transform(l, (x, i) -> named_struct('line', x, 'at', i + 1)), x -> startswith({strip("x.line")}, '--- Page'))),
      marks -> transform(
        filter(zip_with(marks, concat(transform(slice(marks, 2, greatest(size(marks), 1)), x -> x.at), slice(array(size(l) + 1), 1, least(size(marks), 1))),
                        (m, e) -> named_struct('page', try_cast({number} AS INT), 'start', m.at, 'stop', e)),
               s -> s.page IS NOT NULL AND s.stop - s.start > 1),
        s -> named_struct('page', s.page, 'text', array_join(slice(l, s.start + 1, s.stop - s.start - 1), char(10)))))[0])[0]"""
    # Through lambdas, each of which computes once what its body uses often: subqueries of one row would be unfolded.
    features = f"""transform(array(coalesce(content, '')), whole -> transform(array(lower(whole)), low -> transform(array(array_join(slice(split(low, char(10)), 1, 10), char(1))), head -> named_struct(
        'heading', {first_match("head", rule_set.headings)}, 'caption', {first_match("low", rule_set.captions)}, 'keywords', CAST({occurrences("low", rule_set.keywords)} AS INT),
        'words', regexp_count(whole, {text(chr(92) + "S+")}), 'short', length({strip("whole")}) < 100))[0])[0])[0]"""
    return {
        "page_features": ("content STRING", FEATURES, features),
        "heading": ("content STRING", "STRING", first_match("array_join(slice(split(lower(content), char(10)), 1, 10), char(1))", rule_set.headings)),
        "caption": ("content STRING", "STRING", first_match("lower(content)", rule_set.captions)),
        "keyword_count": ("content STRING", "INT", f"CAST({occurrences('lower(content)', rule_set.keywords)} AS INT)"),
        "table_matches": ("header ARRAY<STRING>", "INT", f"transform(array(lower(array_join(transform(header, c -> coalesce(c, '')), ' '))), h -> {count_matches('h', rule_set.tables)})[0]"),
        "package_type": ("name STRING", "STRING", package),
        "package_name": ("name STRING", "STRING", f"coalesce({first_contained(up, rules.NAME_ALIASES)}, {package}, {up})"),
        "part_number": ("file STRING", "STRING", f"nullif(regexp_extract(regexp_replace(file, {text(chr(92).join(['(?<=[^.])', '.[^.]*', 'z']))}, ''), {text(chr(92) + 'A[A-Z0-9-]+')}, 0), '')"),
        "says_yes": ("answer STRING", "BOOLEAN", f"coalesce(startswith({yes}, 'YES') OR NOT startswith({yes}, 'NO'), true)"),
        "blocks": ("content STRING", "ARRAY<STRUCT<page: INT, text: STRING>>", f"coalesce({blocks}, CAST(array() AS ARRAY<STRUCT<page: INT, text: STRING>>))"),
    }


def tables(rule_set: rules.PageRules) -> dict[str, tuple[str, str, str]]:
    """Name: (parameters, columns, query)."""
    reasons = """filter(array(
        CASE WHEN heading_score > 0 THEN concat('heading: ', features.heading) END,
        CASE WHEN table_score > 0 THEN concat('table columns: ', table_matches) END,
        CASE WHEN diagram_score > 0 THEN concat('diagram caption: ', features.caption) END,
        CASE WHEN keyword_score > 0 THEN concat('keywords: ', features.keywords, ' in ', features.words) END,
        CASE WHEN position_score > 0 THEN 'position' END), r -> r IS NOT NULL)"""
    points = """SELECT CAST(features.heading IS NOT NULL AS INT) * 3 AS heading_score, CAST(table_matches IS NOT NULL AS INT) * 4 AS table_score,
      CAST(coalesce(image_share, 0D) >= 0.2D AND features.caption IS NOT NULL AS INT) * 2 AS diagram_score,
      CAST(coalesce(try_divide(CAST(features.keywords AS DOUBLE), CAST(features.words AS DOUBLE)) * 100 >= 2, false) AS INT) * 2 AS keyword_score,
      CAST(coalesce(try_divide(CAST(page_number AS DOUBLE), CAST(total_pages AS DOUBLE)) BETWEEN 0.2D AND 0.7D, false) AS INT) AS position_score"""
    score = f"""SELECT score, heading_score, table_score, diagram_score, keyword_score, position_score, {reasons}, odd, odd OR score BETWEEN verify_from AND min_score - 1
    FROM (SELECT *, (score >= 2 AND table_score = 0 AND diagram_score = 0) OR (features.short AND diagram_score > 0) AS odd
          FROM (SELECT *, heading_score + table_score + diagram_score + keyword_score + position_score AS score FROM ({points})))"""
    return {
        "page_score": (
            f"features {FEATURES}, table_matches INT, image_share DOUBLE, page_number INT, total_pages BIGINT, min_score INT, verify_from INT",
            "score INT, heading_score INT, table_score INT, diagram_score INT, keyword_score INT, position_score INT, reasons ARRAY<STRING>, unusual BOOLEAN, needs_verification BOOLEAN",
            score,
        ),
    }


def register(spark: SparkSession, schema: str | None = None, rule_set: rules.PageRules = rules.PAGE_RULES, prefix: str = "lf_") -> list[str]:
    """Create the functions and return their names: for this session, or in `schema`, where they stay. Those of the same name are
    replaced. Patterns and keywords are those of `rule_set`.

    Null texts: no heading, caption, count or part number; no blocks; the features of an empty text. A null answer says yes."""
    kind, place = ("TEMPORARY FUNCTION", "") if schema is None else ("FUNCTION", f"{schema}.")
    made = []
    for name, (parameters, returned, body) in scalars(rule_set).items():
        made.append(f"{place}{prefix}{name}")
        spark.sql(f"CREATE OR REPLACE {kind} {made[-1]}({parameters}) RETURNS {returned} RETURN {body}")
    for name, (parameters, columns, body) in tables(rule_set).items():
        made.append(f"{place}{prefix}{name}")
        spark.sql(f"CREATE OR REPLACE {kind} {made[-1]}({parameters}) RETURNS TABLE({columns}) RETURN {body}")
    return made
