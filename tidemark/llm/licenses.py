"""Licence scan in DataFrame operations only.

Every window of 1 to WRAP adjacent lines of every file that shares a term with a header template is a possible header; the
whole text of a licence file (a column tells which they are) is compared with the bodies of licences. Texts and templates are
sparse TF-IDF vectors (document frequencies of all terms over all files), and a text's licence is the template of the greatest
cosine, if that reaches `least`. A file's own licence is that of its best header or, for licence files, of its whole text if
that is nearer. Licence files hand their licence to all files below their directory: a file without own licence inherits from its
nearest ancestor directory, found by joining the file's ancestor paths with the directories of licence files.

Terms are [a-z0-9.]+ of the lower-cased line, without dots at their ends and without the stop list; templates have no other terms, so a text that shares none has cosine 0
with each of them.

Defined results: null texts are empty; null paths belong to no directory, neither hand on nor inherit; ties between templates, texts or licence files of a
directory go to the greater cosine and then the lesser name; repeated rows repeat their result; an empty table gives an
empty result; extra columns are not read.
"""

from __future__ import annotations

import math
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._shared import hot_join, written

#: Identifier and header text of licences (fixed values).
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License",
    "CC-BY-4.0": "Licensed under Creative Commons Attribution 4.0 International, CC BY 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "GPL-2.0": "This program is licensed under the GNU General Public License, version 2",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3",
    "MIT": "Released under the MIT License",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0",
}
STOP = ("a", "an", "and", "are", "by", "form", "in", "is", "of", "or", "the", "this", "to", "with", "without", "work", "use", "code", "terms", "subject", "forms", "source")
#: Terms by which a line can share anything with a template.
TERM = r"[a-z0-9.]*[a-z0-9]"


#: A header may be wrapped over so many lines.
WRAP = 3
#: Whole licences, one text a licence, by its name; the licences of Creative Commons have headers only.
BODIES = Path(__file__).with_name("licence_texts")


def _counted(texts: dict[str, str]) -> list[tuple[str, str, int]]:
    out: dict[tuple[str, str], int] = {}
    for name, text in texts.items():
        for term in re.findall(TERM, text.lower()):
            if term not in STOP:
                out[name, term] = out.get((name, term), 0) + 1
    return [(n, t, k) for (n, t), k in sorted(out.items())]


def _template_terms() -> list[tuple[str, str, int]]:
    return _counted(TEMPLATES)


def _body_terms() -> list[tuple[str, str, int]]:
    return _counted({p.stem: p.read_text("utf-8") for p in sorted(BODIES.glob("*.txt"))})


def _terms(text: Column) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"), F.lit(1))
    return F.filter(found, lambda x: ~x.isin(*STOP))


def _once(terms: Column) -> Column:
    """terms, generated, so that a filter on them does not repeat their extraction for every template."""
    return F.explode(F.array(terms))


def frequencies(files: DataFrame, file: str, text: str) -> tuple[int, DataFrame]:
    """The number of files, and term, df over all terms of all files; rows of one file count once."""
    found = F.regexp_extract_all(F.lower(F.col(text)), F.lit(f"({TERM})"), F.lit(1))
    pairs = files.select(F.col(file).alias("f"), F.explode(F.array_except(found, F.array(*map(F.lit, STOP)))).alias("term"))
    n_rows, n_files = files.agg(F.count(file), F.countDistinct(file)).first()
    if n_rows > n_files:  # else the pairs of a row are distinct as they are
        pairs = pairs.distinct()
    return n_files, written(pairs.groupBy("term").agg(F.count("f").alias("df")), "licence-df")


def _idf(n_files: int, df: int) -> float:
    return math.log((1 + n_files) / (1 + df)) + 1


def _rows(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """x, the fields of each row as an array of texts: one literal, as thousands of them take minutes to plan."""
    text = "\n".join("\t".join(map(str, row)) for row in rows)
    return spark.range(1).select(F.explode(F.split(F.lit(text), "\n")).alias("row")).select(F.split("row", "\t").alias("x"))


def _weigh(templates: list[tuple[str, str, int]], n_files: int, df: DataFrame) -> dict[str, dict[str, float]]:
    """Vectors of the templates; their terms are a constant number."""
    terms = _rows(df.sparkSession, sorted({(t,) for _, t, _ in templates})).select(F.col("x")[0].alias("term"))
    known = dict(df.join(F.broadcast(terms), "term").select("term", "df").collect())
    out: dict[str, dict[str, float]] = {}
    for name, term, k in templates:
        out.setdefault(name, {})[term] = k * _idf(n_files, known.get(term, 0))
    return out


def _reaches(terms: Column, vectors: dict[str, dict[str, float]], least: float) -> Column:
    """Whether a text of these terms can have the cosine least with any template. By Cauchy and Schwarz the cosine is at most the
    share of the template's norm that lies in common terms, so texts with fewer of them than its heaviest terms would need cannot."""
    able = F.lit(False)
    for vector in vectors.values():
        squares = sorted((w * w for w in vector.values()), reverse=True)
        need, sum_ = 0, 0.0
        while need < len(squares) and (need == 0 or sum_ < (max(least, 0) - 1e-6) ** 2 * sum(squares)):  # results are rounded
            sum_, need = sum_ + squares[need], need + 1
        able |= F.size(F.array_intersect(terms, F.split(F.lit(" ".join(sorted(vector))), " "))) >= need
    return able


def _compare(units: DataFrame, keys: list[str], vectors: dict[str, dict[str, float]], n_files: int, df: DataFrame) -> DataFrame:
    """keys, license, cosine (6 decimals) of each unit (keys, terms) and each template with which it shares a term."""
    spark = units.sparkSession
    counted = written(units.select(*keys, F.explode("terms").alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf")), "licence-counts")
    # a term of a licence is in every unit
    counted = written(hot_join(counted, df, "term", "df", df.agg(F.sum("df")).first()[0] or 0), "licence-terms")
    rows = [(name, term, w, math.sqrt(sum(x * x for x in v.values()))) for name, v in vectors.items() for term, w in v.items()]
    x = F.col("x")
    templates = F.broadcast(_rows(spark, rows).select(x[0].alias("license"), x[1].alias("term"), x[2].cast("double").alias("t_w"), x[3].cast("double").alias("t_norm")))
    weighted = counted.withColumn("w", F.col("tf") * (F.log(F.lit(1 + n_files) / (1 + F.col("df"))) + 1))
    norms = weighted.groupBy(*keys).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighted.join(templates, "term").groupBy(*keys, "license", "t_norm").agg(F.sum(F.col("w") * F.col("t_w")).alias("dot"))
    return dots.join(norms, keys).select(*keys, "license", F.round(F.col("dot") / (F.col("t_norm") * F.col("norm")), 6).alias("cosine"))


def cosines(files: DataFrame, file: str, text: str, least: float = 0.0, whole: Column | None = None) -> DataFrame:
    """file, line_no, n_lines, license, cosine (6 decimals) of what shares a term with a template, if that reaches least: windows of
    1 to WRAP adjacent lines, and whole texts (n_lines 0) of the rows that whole tells; file must name rows."""
    n_files, df = frequencies(files, file, text)
    vectors = _weigh(_template_terms(), n_files, df)
    words = sorted({t for v in vectors.values() for t in v if not t.replace(".", "").isdigit()})
    # a first look at whole texts, so that only texts with a licence term are split into lines; numbers alone make no header
    shares = lambda c: F.lower(c).rlike(r"(?<![a-z0-9.])(?:" + "|".join(w.replace(".", r"\.") for w in words) + r")(?![a-z0-9])")
    lines = files.select(F.col(file).alias("f"), F.col(text).alias("t")).where(shares("t")).select("f", F.split("t", "\n").alias("lines"))
    sized = lines.select("f", "lines", F.explode(F.sequence(F.lit(1), F.least(F.lit(WRAP), F.size("lines")))).alias("n_lines"))
    windows = F.transform(F.sequence(F.lit(1), F.size("lines") - F.col("n_lines") + 1), lambda i: F.array_join(F.slice("lines", i, F.col("n_lines")), "\n"))
    units = sized.select("f", "n_lines", F.posexplode(windows).alias("line_no", "window")).where(shares("window")).select("f", "line_no", "n_lines", _once(_terms(F.col("window"))).alias("terms"))
    keys = ["f", "line_no", "n_lines"]
    found = _compare(units.where(_reaches(F.col("terms"), vectors, least)), keys, vectors, n_files, df)
    if whole is not None:
        bodies = _weigh(_body_terms(), n_files, df)
        texts = files.where(whole).select(F.col(file).alias("f"), F.lit(0).alias("line_no"), F.lit(0).alias("n_lines"), _once(_terms(F.col(text))).alias("terms"))
        found = found.union(_compare(texts.where(_reaches(F.col("terms"), bodies, least)), keys, bodies, n_files, df))
    return found.where(F.col("cosine") >= least).withColumnRenamed("f", file)


def scan(files: DataFrame, file: str, path: str, text: str, is_license_file: Column, least: float = 0.7) -> DataFrame:
    """file, path, own_license, own_cosine, license, inherited_from (directory, or null) for every row; file must name rows uniquely for inheritance to be told apart."""
    base = files.select(F.col(file).alias("f"), F.col(path).alias("p"), F.col(text).alias("t"), F.coalesce(is_license_file, F.lit(False)).alias("licence_file"))
    best = cosines(base, "f", "t", least, F.col("licence_file")).groupBy("f").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license")).alias("m"))
    own = base.select("f", "p", "licence_file").join(best.select(F.col("f").alias("b"), F.col("m.license").alias("own_license"), (-F.col("m.c")).alias("own_cosine")), F.col("f").eqNullSafe(F.col("b")), "left").drop("b")
    directory = F.regexp_replace("p", "/[^/]*$", "")
    handed = own.where(F.col("licence_file") & F.col("own_license").isNotNull() & F.col("p").contains("/")).groupBy(directory.alias("dir")).agg(F.min(F.struct((-F.col("own_cosine")).alias("c"), F.col("own_license"))).alias("m")).select("dir", F.col("m.own_license").alias("dir_license"))
    # the ancestor paths of the directories that have files, then one row a directory: files of a directory share their answer
    asking = own.where(F.col("p").contains("/")).select(directory.alias("d")).distinct()
    parts = F.split("d", "/")
    ancestors = asking.select("d", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("dir"))
    nearest = ancestors.join(handed, "dir").groupBy("d").agg(F.max(F.struct(F.length("dir").alias("depth"), "dir", "dir_license")).alias("m")).select("d", F.col("m.dir").alias("from_dir"), F.col("m.dir_license").alias("from_license"))
    joined = own.withColumn("d0", F.when(F.col("p").contains("/"), directory)).join(nearest, F.col("d0") == F.col("d"), "left")
    return joined.select(F.col("f").alias(file), F.col("p").alias(path), "own_license", "own_cosine", F.coalesce("own_license", "from_license").alias("license"), F.when(F.col("own_license").isNull(), F.col("from_dir")).alias("inherited_from"))


#: Documents have no paths; the query stands a document at source/lang/<hundreds of its id>/<id>. Those whose id ends in 0 are licence files, and
#: stand in turn (by the digits before) in such a directory, at source/lang/<id> and at source/<id>, so that licences are inherited over one to three levels.
def document_path() -> Column:
    source, lang = F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-"))
    group, name = F.floor(F.col("doc_id") / 100).cast("string"), F.col("doc_id").cast("string")
    level = F.when(is_licence_file(), F.pmod(F.floor(F.col("doc_id") / 10), F.lit(3))).otherwise(F.lit(0))
    return F.when(level == 2, F.concat_ws("/", source, name)).when(level == 1, F.concat_ws("/", source, lang, name)).otherwise(F.concat_ws("/", source, lang, group, name))


def is_licence_file() -> Column:
    return F.pmod(F.col("doc_id"), F.lit(10)) == 0


def op10(docs: DataFrame) -> DataFrame:
    """Licence of every document, own or inherited; see document_path for where documents stand."""
    files = docs.select("doc_id", document_path().alias("path"), "text")
    return scan(files, "doc_id", "path", "text", is_licence_file())


def op10_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    values = lambda rows: ", ".join(f"({quoted(a)}, {quoted(b)}, {k})" for a, b, k in rows)
    words = sorted({t for _, t, _ in _template_terms() if not t.replace(".", "").isdigit()})
    any_word = r"(^|[^a-z0-9.])(" + "|".join(w.replace(".", r"\.") for w in words) + r")($|[^a-z0-9])"
    stop = ", ".join(map(quoted, STOP))
    windows = " UNION ALL ".join(f"SELECT doc_id, {n} AS n_lines, unnest(list_transform(range(1, len(lines) - {n} + 2), lambda i: {{'i': i, 'w': array_to_string(lines[i : i + {n - 1}], chr(10))}})) AS x FROM split WHERE len(lines) >= {n}" for n in range(1, WRAP + 1))
    return f"""
WITH files AS (
  SELECT doc_id, text, doc_id % 10 = 0 AS licence_file, coalesce(source, '-') AS s, coalesce(lang, '-') AS l,
         CASE WHEN doc_id % 10 = 0 THEN CAST(floor(doc_id / 10) AS BIGINT) % 3 ELSE 0 END AS level
  FROM documents
), placed AS (
  SELECT doc_id, text, licence_file, CASE level WHEN 2 THEN s WHEN 1 THEN s || '/' || l ELSE s || '/' || l || '/' || CAST(CAST(floor(doc_id / 100) AS BIGINT) AS VARCHAR) END AS dir FROM files
), n AS (SELECT count(DISTINCT doc_id) AS n_files FROM documents),
df AS (
  SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{TERM}')) AS term FROM documents) WHERE term NOT IN ({stop}) GROUP BY term
), split AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE regexp_matches(lower(text), '{any_word}')),
windows AS ({windows}),
units AS (
  SELECT 'header' AS kind, doc_id, n_lines, x.i AS line_no, x.w AS t FROM windows WHERE regexp_matches(lower(x.w), '{any_word}')
  UNION ALL SELECT 'body', doc_id, 0, 0, text FROM placed WHERE licence_file AND text IS NOT NULL
), terms AS (
  SELECT kind, doc_id, n_lines, line_no, term, count(*) AS tf FROM (SELECT kind, doc_id, n_lines, line_no, unnest(regexp_extract_all(lower(t), '{TERM}')) AS term FROM units) WHERE term NOT IN ({stop}) GROUP BY ALL
), templates(kind, license, term, k) AS (
  SELECT 'header', * FROM (VALUES {values(_template_terms())}) UNION ALL SELECT 'body', * FROM (VALUES {values(_body_terms())})
), tw AS (SELECT kind, license, term, k * (ln((1 + n_files) / (1 + coalesce(df, 0))) + 1) AS w FROM templates LEFT JOIN df USING (term), n),
tn AS (SELECT kind, license, sqrt(sum(w * w)) AS t_norm FROM tw GROUP BY ALL),
uw AS (SELECT kind, doc_id, n_lines, line_no, term, tf * (ln((1 + n_files) / (1 + df)) + 1) AS w FROM terms JOIN df USING (term), n),
un AS (SELECT kind, doc_id, n_lines, line_no, sqrt(sum(w * w)) AS u_norm FROM uw GROUP BY ALL),
dots AS (SELECT kind, doc_id, n_lines, line_no, license, sum(uw.w * tw.w) AS dot FROM uw JOIN tw USING (kind, term) GROUP BY ALL),
cos AS (SELECT doc_id, license, round(dot / (t_norm * u_norm), 6) AS cosine FROM dots JOIN tn USING (kind, license) JOIN un USING (kind, doc_id, n_lines, line_no)),
best AS (SELECT doc_id, license AS own_license, cosine AS own_cosine FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, license) AS r FROM cos WHERE cosine >= 0.7) WHERE r = 1),
own AS (SELECT f.doc_id, f.dir, f.licence_file, b.own_license, b.own_cosine FROM placed f LEFT JOIN best b USING (doc_id)),
handed AS (SELECT dir, own_license AS dir_license FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY own_cosine DESC, own_license) AS r FROM own WHERE licence_file AND own_license IS NOT NULL) WHERE r = 1),
nearest AS (
  SELECT d, dir AS from_dir, dir_license AS from_license FROM (
    SELECT a.d, h.dir, h.dir_license, row_number() OVER (PARTITION BY a.d ORDER BY length(h.dir) DESC) AS r
    FROM (SELECT DISTINCT dir AS d FROM own) a JOIN handed h ON a.d = h.dir OR starts_with(a.d, h.dir || '/')
  ) WHERE r = 1
)
SELECT o.doc_id, o.dir || '/' || CAST(o.doc_id AS VARCHAR) AS path, own_license, own_cosine, coalesce(own_license, from_license) AS license,
       CASE WHEN own_license IS NULL THEN from_dir END AS inherited_from
FROM own o LEFT JOIN nearest ON o.dir = nearest.d
"""
