"""Deterministic texts over the table documents that exercise links, headings and markup.

The same SQL runs in Spark and in DuckDB. Every document gives one card and one paper.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CARD = """
SELECT doc_id, lang,
 concat('org', cast(doc_id % 7 AS varchar(20)), '/model-', cast(doc_id % 23 AS varchar(20)), '-base') AS model_id,
 concat('---', chr(10), 'language: ', lang, chr(10), 'license: apache-2.0', chr(10), '---', chr(10),
  '# Card ', cast(doc_id AS varchar(20)), chr(10),
  CASE WHEN doc_id % 3 = 0 THEN concat('Paper: https://arxiv.org/abs/', lpad(cast(2001 + doc_id % 900 AS varchar(20)), 4, '0'), '.', lpad(cast(doc_id % 99991 AS varchar(20)), 5, '0'), chr(10)) ELSE '' END,
  CASE WHEN doc_id % 5 = 0 THEN concat('See https://huggingface.co/papers/2101.', lpad(cast(doc_id % 777 AS varchar(20)), 5, '0'), ' too.', chr(10)) ELSE '' END,
  CASE WHEN doc_id % 2 = 0 THEN concat('Code: https://github.com/org', cast(doc_id % 7 AS varchar(20)), '/model-', cast(doc_id % 23 AS varchar(20)), '/blob/main/run.py', chr(10)) ELSE '' END,
  CASE WHEN doc_id % 4 = 1 THEN concat('Logo https://github.com/acme/assets-', cast(doc_id % 11 AS varchar(20)), '/raw/x.png and https://github.com/acme', chr(10)) ELSE '' END,
  CASE WHEN doc_id % 6 = 1 THEN concat('Also https://github.com/lab/tools/issues/', cast(doc_id AS varchar(20)), ' and https://github.com/lab/tools', chr(10)) ELSE '' END,
  'Training used batch size ', cast(doc_id % 64 AS varchar(20)), ' [1, 2] (Doe et al., 2020). Contact a', cast(doc_id AS varchar(20)), '@mail.example.com for help.', chr(10),
  coalesce(text, '')) AS card
FROM {documents}
"""

PAPER = """
SELECT doc_id, concat('ABSTRACT', chr(10), 'We study models of ', cast(doc_id AS varchar(20)), ' kinds.', chr(10),
 '1 Introduction', chr(10), 'This is what others did (Doe et al., 2020).', chr(10),
 '2 Method', chr(10), 'The ', chr(92), 'alpha loss of https://site.example.org/p', cast(doc_id AS varchar(20)), ' is', chr(10), 'continued by ', chr(92), 'beta terms here.', chr(10),
 '2.1 Data', chr(10), coalesce(text, ''), chr(10), 'See https://data.example.org/d', cast(doc_id % 9 AS varchar(20)), ' for the files of it.', chr(10),
 'RESULTS', chr(10), 'Row | a | b | c', chr(10), 'It works in e.g. tests and Fig. 3 shows how. Doe et al. agree with all of this!', chr(10),
 '2 Method', chr(10), 'A later remark on the method follows.', chr(10),
 'REFERENCES', chr(10), 'Smith, J., Doe, A., Roe, B., 2020. Journal of Things.') AS paper
FROM {documents}
"""


def cards(spark: SparkSession, documents: DataFrame) -> DataFrame:
    return spark.sql(CARD, documents=documents)


def papers(spark: SparkSession, documents: DataFrame) -> DataFrame:
    return spark.sql(PAPER, documents=documents)


def in_duckdb(sql: str) -> str:
    return sql.replace("{documents}", "documents")
