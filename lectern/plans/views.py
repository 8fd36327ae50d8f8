"""Item-bank, page and job tables derived from the star-schema tables.

VIEWS is SQL that Spark and DuckDB read alike; the Spark side binds the names in braces
to DataFrames, the other side prefixes a query with the views it names.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "question": """
SELECT p_partkey AS id, p_name AS title, CASE WHEN p_size % 6 = 0 THEN p_name || ' 옳지 않은 것은?' ELSE p_name END AS ask, p_brand AS brand,
  CASE WHEN split_part(p_type, ' ', 1) IN ('ECONOMY', 'SMALL') THEN '정답형' WHEN split_part(p_type, ' ', 1) IN ('MEDIUM', 'LARGE') THEN '합답형'
       WHEN split_part(p_type, ' ', 1) = 'STANDARD' THEN '서술형' ELSE 'PROMO' END AS qtype,
  CASE WHEN p_size = 1 THEN '' ELSE p_brand END AS standard_code,
  CASE WHEN p_size <= 15 THEN '하' WHEN p_size <= 35 THEN '중' WHEN p_size <= 48 THEN '상' ELSE '최상' END AS difficulty,
  CAST(p_size % 6 AS DOUBLE) AS default_points,
  CASE p_partkey % 3 WHEN 0 THEN '초안' WHEN 1 THEN '검토중' ELSE '완성' END AS status,
  CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN '직접' WHEN 2 THEN 'AI초안' WHEN 3 THEN '기출변형' ELSE '기타' END AS origin,
  CASE p_partkey % 4 WHEN 0 THEN '지식·이해' WHEN 1 THEN '과정·기능' WHEN 2 THEN '가치·태도' ELSE '' END AS behavior,
  p_size % 7 = 0 AS is_negative, CASE WHEN p_partkey % 9 = 0 THEN '②③' ELSE '' END AS answer,
  CAST(p_partkey % 977 AS STRING) AS created_at, CAST(NULL AS STRING) AS updated_at
FROM {part}""",
    "set_item": """
SELECT l_orderkey AS set_id, l_partkey AS question_id, CAST(l_linenumber AS BIGINT) AS ord, CASE WHEN l_quantity > 25 THEN l_quantity END AS points,
  l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) AS item_id,
  l_suppkey, l_returnflag, l_linestatus, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax
FROM {lineitem}""",
    "choice": """
SELECT question_id, item_id AS choice_id, CAST(l_linenumber % 5 + 1 AS BIGINT) AS ord, l_returnflag = 'R' AS is_answer, l_suppkey AS proposition_id,
  repeat(l_linestatus, l_linenumber) AS text
FROM {set_item}""",
    "option": """
SELECT question_id, CAST(l_linenumber % 5 + 1 AS BIGINT) AS ord, CASE WHEN question_id % 13 = 0 THEN false WHEN question_id % 11 = 0 THEN l_linenumber % 5 < 2 ELSE l_linenumber % 5 = question_id % 8 % 5 END AS is_answer
FROM (SELECT DISTINCT question_id, l_linenumber FROM {set_item} WHERE l_linenumber <= 5) o""",
    "item": """
SELECT s.set_id, s.question_id, s.ord, s.item_id, s.points, 100.0E0 AS target, q.title, q.qtype, q.standard_code, q.difficulty, q.default_points,
  q.status, q.origin, q.behavior, q.answer
FROM {set_item} s JOIN {question} q ON s.question_id = q.id""",
    "standard": """
SELECT p_brand AS code, CAST(min(p_partkey) AS BIGINT) AS seq, min(p_name) AS text, TRY_CAST(substr(p_brand, 7) AS INT) % 5 AS unit_no,
  CASE WHEN max(p_size) >= 50 THEN 'long' ELSE '' END AS explain
FROM {part} GROUP BY p_brand""",
    "unit": "SELECT r_regionkey AS unit_no, r_name AS name, r_regionkey % 2 AS subject_id FROM {region}",
    "subject": "SELECT DISTINCT r_regionkey % 2 AS subject_id FROM {region}",
    "proposition": "SELECT c_custkey AS id, c_name AS text, c_nationkey AS unit_no, c_mktsegment AS tags, 'Brand#' || CAST(c_custkey % 25 + 1 AS STRING) AS standard_code FROM {customer}",
    "evidence": "SELECT o_custkey AS proposition_id, o_orderkey AS evidence_id FROM {orders} WHERE substr(o_orderpriority, 1, 1) IN ('1', '2')",
    "variant": "SELECT o_custkey AS proposition_id, o_orderkey AS variant_id FROM {orders} WHERE NOT substr(o_orderpriority, 1, 1) IN ('1', '2')",
    "exam_set": "SELECT o_orderkey AS set_id, o_orderstatus AS status, 100.0E0 AS target FROM {orders}",
    "labelled": """
SELECT d.doc_id, d.lang, d.source, CASE WHEN l.toxic = 1 THEN 'failure' WHEN l.quality = 0 THEN 'manual' WHEN l.quality = 1 THEN 'ready' ELSE 'queued' END AS status
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""",
    "box": """
SELECT set_id AS page, item_id AS box_id, l_returnflag AS flag, l_quantity * 10 AS x0, l_extendedprice / 100 AS y0,
  l_quantity * 10 + 20 + l_tax * 500 AS x1, l_extendedprice / 100 + 10 + l_discount * 300 AS y1
FROM {set_item}""",
    "region_box": "SELECT page, flag, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM {box} GROUP BY page, flag",
    "operation": """
SELECT user_id AS op_id, event_id AS seq, ts, CASE event_type WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'queued' ELSE 'running' END AS status,
  CAST(least(100, greatest(0, CAST(floor(value) AS INT))) AS BIGINT) AS progress, event_type, CAST(floor(value) AS BIGINT) AS whole
FROM {events}""",
    "stage": """
SELECT source, stage, rank, min(seq) % 11 <> 0 AS valid
FROM (SELECT op_id AS source, event_type AS stage, seq, CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 WHEN 'purchase' THEN 4 ELSE 5 END AS rank FROM {operation}) s
GROUP BY source, stage, rank""",
    "job_item": """
SELECT l_orderkey AS job_id, item_id, CASE l_returnflag WHEN 'R' THEN 'failed' WHEN 'A' THEN 'manual_required' ELSE 'ready' END AS status,
  l_linenumber % 2 = 0 AS selected, l_linestatus = 'F' AS confirmed, repeat('x', CAST(l_linenumber % 3 AS INT)) AS text
FROM (SELECT set_id AS l_orderkey, item_id, l_returnflag, l_linenumber, l_linestatus FROM {set_item}) j""",
    "talk_line": "SELECT conv_id AS id, CAST(turn AS INT) AS turn, role, text, split_part(text, ' ', 1) AS word, length(text) AS size FROM {conversations}",
    "draft": """
SELECT id, CASE max(CASE WHEN turn = 0 THEN size END) % 5 WHEN 0 THEN '서술형' WHEN 1 THEN '정답형' ELSE '합답형' END AS qtype,
  max(CASE WHEN turn = 0 THEN CASE size % 3 WHEN 0 THEN '그림은 ' || word || '을 나타낸 것이다.' WHEN 1 THEN '' ELSE text END END) AS passage,
  max(CASE WHEN turn = 1 THEN CASE size % 4 WHEN 0 THEN word || '에 대한 설명으로 옳은 것은?' WHEN 1 THEN '이에 대한 설명으로 옳은 것만을 <보기>에서 있는 대로 고른 것은? [3점]' WHEN 2 THEN ' ' ELSE text END END) AS ask,
  max(CASE WHEN turn = 1 THEN CASE size % 3 WHEN 0 THEN '[[formula:' || word || ' α]]' WHEN 1 THEN '[[formula:' || word ELSE text END END) AS explanation,
  CASE sum(size) % 7 WHEN 0 THEN chr(123) || '"reconstruction": ' || chr(123) || '"enabled": true' || chr(125) || chr(125) WHEN 1 THEN chr(123) WHEN 2 THEN '' ELSE chr(123) || '"reconstruction": ' || chr(123) || '"enabled": false' || chr(125) || chr(125) END AS style_meta
FROM {talk_line} GROUP BY id""",
    "claim": """
SELECT id, turn - 1 AS idx, CASE WHEN size % 2 = 0 THEN word || ' 크다.' ELSE text END AS text, CASE WHEN size % 3 = 0 THEN ' ' ELSE role END AS evidence,
  CASE WHEN role = 'user' THEN '' ELSE word END AS explanation, CAST(CASE WHEN size % 5 = 0 THEN size END AS BIGINT) AS proposition_id
FROM {talk_line} WHERE turn >= 2""",
    "draft_choice": """
SELECT id, turn + 1 AS idx, CASE WHEN size % 4 = 1 THEN '' ELSE text END AS text, size % 4 = 0 AS is_answer, CAST(CASE WHEN size % 5 < 2 THEN size END AS BIGINT) AS proposition_id, CASE WHEN role = 'user' THEN ' ' ELSE '' END AS custom_evidence,
  CASE size % 6 WHEN 0 THEN '["ㄱ","ㄷ"]' WHEN 1 THEN 'ㄱ, ' || word || ',' WHEN 2 THEN '[' || word ELSE '' END AS combo
FROM {talk_line}""",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Views:
    """Tables and views of one folder as DataFrames, made when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.made = spark, sf_dir, {}

    def __call__(self, name: str) -> DataFrame:
        if name not in self.made:
            if name in TABLES:
                self.made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                self.made[name] = self.sql(VIEWS[name])
        return self.made[name]

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text, **{n: self(n) for n in re.findall(r"\{(\w+)\}", text)})


@lru_cache
def needs(name: str) -> tuple[str, ...]:
    """The views that a view needs, before it, and itself."""
    found: dict[str, None] = {}
    for n in re.findall(r"\{(\w+)\}", VIEWS[name]):
        if n in VIEWS:
            found.update(dict.fromkeys(needs(n)))
    return (*found, name)


def with_views(sql: str) -> str:
    """`sql` after the views that it names in braces; further WITH parts of its own may follow."""
    names: dict[str, None] = {}
    for n in re.findall(r"\{(\w+)\}", sql):
        if n in VIEWS:
            names.update(dict.fromkeys(needs(n)))
    plain = lambda s: re.sub(r"\{(\w+)\}", r"\1", s)
    views = ", ".join(f"{n} AS ({plain(VIEWS[n])})" for n in names)
    body = plain(sql.strip())
    if not names:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {views}, {body[15:]}"
    return f"WITH {views}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {views} {body}"
