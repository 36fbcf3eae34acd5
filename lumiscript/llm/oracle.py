"""SQL for the training-data queries that SQL can express; the others are tested in tests/llm."""

SQL = {
    "p2_agreement": r"""
WITH clean AS (
  SELECT id, tag, nullif(upper(regexp_replace(annotator, '[\s\x{200B}-\x{200F}\x{FEFF}]+', '', 'g')), '') AS annotator, labels, labelled_at
  FROM labels WHERE labels IS NOT NULL AND id IS NOT NULL AND tag IS NOT NULL
), last AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, tag, annotator ORDER BY labelled_at DESC) AS rn FROM clean WHERE annotator IS NOT NULL) WHERE rn = 1
), entries AS (
  SELECT id, tag, unnest(map_entries(labels)) AS e FROM last
), per AS (
  SELECT id, tag, e.key AS code, count(*) AS n, sum(CASE WHEN e.value THEN 1 ELSE 0 END) AS t
  FROM entries WHERE e.value IS NOT NULL GROUP BY id, tag, e.key HAVING count(*) >= 2
), scored AS (
  SELECT *, (t * (t - 1) + (n - t) * (n - t - 1)) / CAST(n * (n - 1) AS DOUBLE) AS agree FROM per
), by_code AS (
  SELECT code, count(*) AS n_items, CAST(sum(n) AS BIGINT) AS n_votes, avg(agree) AS po, avg(t / CAST(n AS DOUBLE)) AS p, sum(t) / CAST(sum(n) AS DOUBLE) AS w FROM scored GROUP BY code
)
SELECT code, n_items, n_votes, round(po, 6) AS observed,
  round(CASE WHEN w * w + (1 - w) * (1 - w) >= 1 THEN 1.0 ELSE (po - (w * w + (1 - w) * (1 - w))) / (1 - (w * w + (1 - w) * (1 - w))) END, 6) AS kappa,
  round(CASE WHEN 2 * p * (1 - p) >= 1 THEN 1.0 ELSE (po - 2 * p * (1 - p)) / (1 - 2 * p * (1 - p)) END, 6) AS ac1
FROM by_code
""",
}
