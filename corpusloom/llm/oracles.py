"""SQL that DuckDB runs on the same tables, for the queries that SQL can express over whole tables."""

from __future__ import annotations

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160) || chr(5760) || chr(8239) || chr(8287) || chr(12288) || " + " || ".join(
    f"chr({c})" for c in (28, 29, 30, 31, *range(8192, 8203), 8232, 8233)
)


def _strip(c: str) -> str:
    return f"trim({c}, {_BLANKS})"


def _number(c: str) -> str:
    s = _strip(c)
    return f"CASE WHEN regexp_full_match({s}, '[+-]?([0-9]+[.][0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN TRY_CAST({s} AS DOUBLE) END"


_RECORDS = f"""
WITH rec AS (
  SELECT file_name, lower(nullif({_strip("speaker_id")}, '')) AS speaker,
    lower(coalesce(nullif({_strip("split")}, ''), 'train')) AS split,
    {_number("dnsmos")} AS dnsmos, {_number("cer")} AS cer
  FROM (SELECT *, row_number() OVER (PARTITION BY file_name ORDER BY exported_at DESC) AS rn FROM metadata) WHERE rn = 1
), star AS (SELECT max(max_records) AS max_records, max(keep_pct) AS keep_pct FROM curation_target WHERE speaker_id = '*')
"""

_RANKED = (
    _RECORDS
    + """, ranked AS (
  SELECT rec.file_name, rec.speaker, CASE WHEN t.speaker_id IS NULL THEN star.max_records ELSE t.max_records END AS cap,
    row_number() OVER (PARTITION BY speaker ORDER BY dnsmos DESC NULLS LAST, cer NULLS LAST, file_name) AS rn
  FROM rec CROSS JOIN star LEFT JOIN curation_target t ON t.speaker_id = rec.speaker AND t.speaker_id <> '*'
)
"""
)

_CUT = (
    _RECORDS
    + """, scored AS (
  SELECT rec.file_name, rec.speaker, rec.dnsmos, count(*) OVER (PARTITION BY speaker) AS n,
    row_number() OVER (PARTITION BY speaker ORDER BY dnsmos DESC) AS rn,
    least(CASE WHEN t.speaker_id IS NULL THEN star.keep_pct ELSE t.keep_pct END, 100) AS pct
  FROM rec CROSS JOIN star LEFT JOIN curation_target t ON t.speaker_id = rec.speaker AND t.speaker_id <> '*'
  WHERE rec.speaker IS NOT NULL AND rec.dnsmos IS NOT NULL
), cut AS (
  SELECT speaker, n, greatest((pct * n + 99) // 100, 1) AS wanted, dnsmos AS cutoff FROM scored
  WHERE rn = greatest((pct * n + 99) // 100, 1)
)
"""
)

ORACLES = {
    "p1_found": _RANKED + "SELECT file_name FROM ranked WHERE speaker IS NOT NULL AND rn > cap",
    "p1_kept_per_speaker": _RANKED
    + "SELECT speaker AS speaker_id, count(*) AS kept FROM ranked WHERE speaker IS NULL OR cap IS NULL OR rn <= cap GROUP BY speaker",
    "p3_found": _CUT + "SELECT file_name FROM scored JOIN cut USING (speaker) WHERE dnsmos >= cutoff",
    "p3_cutoffs": _CUT
    + "SELECT speaker AS speaker_id, cutoff, cut.n AS n, wanted, count(*) AS kept FROM scored JOIN cut USING (speaker) WHERE dnsmos >= cutoff GROUP BY ALL",
    "p4_found": _RECORDS + "SELECT speaker AS speaker_id FROM rec WHERE speaker IS NOT NULL GROUP BY speaker HAVING count(DISTINCT split) > 1",
    # results that any right assignment, packing or mixture must have
    "p4_split_checks": "SELECT count(DISTINCT file_name) AS records, 0 AS torn_speakers, 0 AS missed_shares FROM metadata",
    "p6_packing_checks": """SELECT spec_id, 0 AS overfull, (SELECT count(*) FROM documents WHERE text <> '') AS documents, 0 AS changed, 0 AS cut_too_often
      FROM pack_spec WHERE capacity_tokens > 0""",
    "p7_share_checks": "SELECT source, round(100.0 * weight_pct / (SELECT sum(weight_pct) FROM mix_target), 6) AS wanted_pct, false AS off, 0 AS over FROM mix_target",
}
