"""The jobs as queries over the driver's tables, each run twice into one new folder, and their SQL."""

from __future__ import annotations

import uuid

from crucible.functions.tables import shared_folder
from crucible.oracle import VARIANTS
from jobs import evidence_upkeep, text_catalogue


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def job1_evidence_upkeep(spark, sf_dir):
    """The second run finds nothing new and changes nothing. Events are one file: as a pattern, since a stream takes a plain path for a folder."""
    at = _folder(spark, "job1")
    for _ in range(2):
        evidence_upkeep.run(spark, f"{sf_dir}/[e]vents.parquet", f"{sf_dir}/customer.parquet", f"{at}/out", f"{at}/checkpoint")
    return spark.read.parquet(f"{at}/out/variants").drop("part", "through")


def job2_text_catalogue(spark, sf_dir):
    at = _folder(spark, "job2")
    for _ in range(2):
        _, catalogue = text_catalogue.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", at)
    return catalogue


QUERIES = {"job1_evidence_upkeep": job1_evidence_upkeep, "job2_text_catalogue": job2_text_catalogue}

SQL = {
    "job1_evidence_upkeep": f"WITH {VARIANTS} SELECT * FROM variants",
    "job2_text_catalogue": """WITH marked AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
facts AS (SELECT doc_id, source, lang, sha256(coalesce(text, '')) AS text_key, length(coalesce(text, '')) AS length, quality, toxic FROM documents LEFT JOIN marked USING (doc_id)),
groups AS (SELECT text_key, count(*) AS group_size, min(doc_id) AS winner, count(DISTINCT lang) + CAST(count(*) FILTER (lang IS NULL) > 0 AS INT) > 1 AS clash FROM facts GROUP BY 1)
SELECT doc_id, source, text_key, length, group_size, CASE WHEN clash THEN doc_id ELSE winner END AS canonical_id,
  CASE WHEN clash THEN 'kept_conflict' WHEN doc_id = winner THEN 'kept' ELSE 'merged_strict_exact' END AS dedup_status, quality, toxic
FROM facts JOIN groups USING (text_key)""",
}
