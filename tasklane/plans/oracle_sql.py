"""DuckDB twins of the derived inputs in ``tasklane.plans.fixtures``.

Each constant is a CTE body. Tables are the pre-registered views.
DuckDB lists are 1-based; integer division is ``//``.
"""

from tasklane.functions.text import FULL_WIDTH, HALF_WIDTH


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


HALF = _q(HALF_WIDTH)
FULL = _q(FULL_WIDTH)

CORPUS = f"""
corpus AS (
  SELECT 0 AS prio, item_id + 1000000000 AS pos, text FROM benchmark
  UNION ALL SELECT 0, doc_id, text FROM documents WHERE doc_id % 7 = 0
  UNION ALL SELECT 1, doc_id,
         CASE WHEN doc_id % 6 = 0 THEN translate(text, {HALF}, {FULL})
              ELSE text END
    FROM documents WHERE doc_id % 3 = 0
  UNION ALL SELECT 2, doc_id, text FROM documents WHERE doc_id % 2 = 0
  UNION ALL SELECT 3, doc_id, text FROM documents
)"""

SCORED = """
scored AS (
  SELECT vec_id AS id, CAST(vec_id % 3 AS INTEGER) AS task_id,
         [3, 7, 10][vec_id % 3 + 1] AS n_classes,
         CAST(label % [3, 7, 10][vec_id % 3 + 1] AS INTEGER) AS target,
         list_transform(embedding[1:[3, 7, 10][vec_id % 3 + 1]],
                        lambda x: CAST(x AS DOUBLE)) AS logits,
         CAST(vec_id // 32 AS BIGINT) AS batch_id
  FROM embeddings
)"""

TOKENS = """
tokens AS (
  SELECT CAST(vec_id // 8 AS BIGINT) AS id, CAST(vec_id % 8 AS INTEGER) AS pos,
         list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vec,
         (vec_id % 8) < 1 + (vec_id // 8) % 8 AS mask
  FROM embeddings
)"""

LAYERS = """
layers AS (
  SELECT CAST(vec_id // 4 AS BIGINT) AS id, CAST(vec_id % 4 AS INTEGER) AS layer,
         list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vec
  FROM embeddings
)"""

PARAMS = """
params AS (
  SELECT CAST(vec_id % 3 AS INTEGER) AS model_id, CAST(vec_id % 3 AS INTEGER) AS ord,
         CASE WHEN (vec_id // 3) % 20 = 0 THEN 'head.' || CAST(vec_id % 3 AS VARCHAR)
              WHEN (vec_id // 3) % 20 = 1 THEN 'emb.position_ids'
              ELSE 'shared.' || CAST((vec_id // 3) % 20 AS VARCHAR) END AS name,
         CAST((vec_id // 3) // 20 AS INTEGER) AS chunk,
         list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vals
  FROM embeddings
)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"
