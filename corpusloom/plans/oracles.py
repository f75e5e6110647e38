"""SQL that DuckDB runs on the same tables, by query name."""

from __future__ import annotations

# what str.strip takes off, spelt for trim
_BLANKS = "' ' || " + " || ".join(f"chr({c})" for c in (*range(9, 14), *range(28, 32), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288))


def _strip(c: str) -> str:
    return f"trim({c}, {_BLANKS})"


_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"


def _clean(c: str) -> str:
    return f"trim(regexp_replace(replace(coalesce({c}, ''), '\"', ''), '{_SPACE}', ' ', 'g'))"


_NORM = _clean("coalesce(nullif(text_normalized, ''), nullif(text, ''))")

_MAN = f"""
WITH man AS (
  SELECT *, {_NORM} AS norm_text,
    CASE WHEN NOT isnan(coalesce(dnsmos, snr_db, 0)) AND NOT isnan(coalesce(cer, 0))
      THEN (CASE WHEN dnsmos IS NOT NULL THEN dnsmos * 10.0 ELSE least(coalesce(snr_db, 0.0), 40.0) END) - 100.0 * coalesce(cer, 0.0) END AS score
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC) AS rn FROM manifest) WHERE rn = 1
), judged AS (
  SELECT *, CASE
    WHEN coalesce(audio_path, '') = '' THEN 'audio_missing'
    WHEN norm_text = '' THEN 'empty_text'
    WHEN cer IS NULL THEN 'cer_missing'
    WHEN cer > 0.02 AND NOT isnan(cer) THEN 'cer'
    WHEN duration IS NULL THEN 'duration_missing'
    WHEN duration < 2.0 THEN 'too_short'
    WHEN duration > 13.0 AND NOT isnan(duration) THEN 'too_long'
    WHEN clipping > 0.001 AND NOT isnan(clipping) THEN 'clipping'
    WHEN multi_speaker THEN 'multi_speaker'
    WHEN dnsmos < 3.0 THEN 'dnsmos'
    WHEN dnsmos IS NULL AND (snr_db IS NULL OR snr_db < 20.0) THEN 'snr'
    WHEN sr < 22050 THEN 'sample_rate'
    WHEN duration * 50.0 > 1520 AND NOT isnan(duration) THEN 'semantic_too_long'
    WHEN coalesce(speaker_id, '') = '' THEN 'speaker_missing' END AS reason
  FROM man
), passed AS (SELECT *, count(*) OVER (PARTITION BY speaker_id) AS n FROM judged WHERE reason IS NULL
), accepted AS (SELECT * FROM passed WHERE n >= 2)
"""

_REFS = (
    _MAN
    + """, pool AS (
  SELECT id, speaker_id, audio_path AS path, duration BETWEEN 3.0 AND 15.0 AS ranged,
    coalesce(score, '-inf'::DOUBLE) AS s FROM accepted
), pair AS (
  SELECT a.id, b.path, b.ranged,
    row_number() OVER (PARTITION BY a.id, b.ranged ORDER BY b.s DESC, b.id) AS in_class,
    row_number() OVER (PARTITION BY a.id ORDER BY b.s DESC, b.id) AS in_all
  FROM accepted a JOIN pool b ON a.speaker_id = b.speaker_id AND a.id <> b.id
), listed AS (
  SELECT id, string_agg(path, '|' ORDER BY in_class) FILTER (ranged AND in_class <= 3) AS a,
    string_agg(path, '|' ORDER BY in_all) FILTER (in_all <= 3) AS b FROM pair GROUP BY id
), refs AS (
  SELECT accepted.*, coalesce(a, b, '') AS refs, CASE WHEN a IS NOT NULL THEN 'range' WHEN b IS NOT NULL THEN 'fallback' ELSE 'none' END AS ref_source
  FROM accepted LEFT JOIN listed USING (id)
)
"""
)

_SPLIT = f"CASE WHEN lower({_strip("coalesce(split, '')")}) IN ('', 'train') THEN 'train' ELSE 'val' END"
_STEM = r"regexp_replace(regexp_extract(file_name, '([^/]*)$', 1), '(.)\.[^.]*$', '\1')"


def _float(c: str) -> str:
    s = f"lower({_strip(c)})"
    return f"CASE WHEN {s} NOT IN ('', 'nan', 'none', 'null') AND NOT isnan(try_cast({s} AS DOUBLE)) THEN try_cast({s} AS DOUBLE) END"


_META = f"""
WITH meta AS (
  SELECT {_STEM} AS id, file_name, source_path, text, {_strip("speaker_id")} AS speaker_id, {_float("duration")} AS duration, {_float("snr_db")} AS snr_db,
    {_float("dnsmos")} AS dnsmos, {_float("cer")} AS cer, {_float("clipping")} AS clipping,
    coalesce(lower({_strip("multi_speaker")}) IN ('true', '1', 'yes'), false) AS multi_speaker,
    upper({_strip("coalesce(tier, '')")}) AS tier, lower(coalesce(nullif({_strip("split")}, ''), 'train')) AS split, {_NORM} AS norm_text
  FROM (SELECT *, row_number() OVER (PARTITION BY file_name ORDER BY exported_at DESC) AS rn FROM metadata) WHERE rn = 1
)
"""

_VEC = "WITH vec AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings) "
_NORM2 = "sqrt(list_sum(list_transform({0}, lambda x: x * x)))"
_ROUNDED = "round({0}, 6)"

# the chunk ends of a sequence of n tokens, and the one before each
_CHUNKS = """
WITH due AS (
  SELECT id, n, list_concat(CASE WHEN n >= 25 THEN range(25, n + 1, 50) ELSE [] END,
    CASE WHEN n > coalesce(list_last(CASE WHEN n >= 25 THEN range(25, n + 1, 50) END), 0) THEN [n::BIGINT] ELSE [] END) AS ends,
    coalesce(list_last(CASE WHEN n >= 25 THEN range(25, n + 1, 50) END), 0) AS full_end
  FROM token_seqs
), chunk AS (
  SELECT id, n, i - 1 AS chunk_idx, greatest(0, coalesce(CASE WHEN i > 1 THEN ends[i - 1] END, 0) - 10) AS start, ends[i] AS end_, ends[i] > full_end AS is_final
  FROM (SELECT *, unnest(range(1, len(ends) + 1)) AS i FROM due)
)
"""

_FINAL = (
    _REFS
    + f""", kept AS (SELECT *, {_SPLIT} AS part FROM refs WHERE ref_source <> 'none'
), gone AS (
  SELECT reason FROM judged WHERE reason IS NOT NULL
  UNION ALL SELECT 'speaker_too_few_utts' FROM passed WHERE n < 2
  UNION ALL SELECT 'no_reference' FROM refs WHERE ref_source = 'none'
)
"""
)

_TOKENS = """
WITH shaped AS (SELECT id, list_concat([8192::BIGINT], tokens, [8193::BIGINT]) AS x, list_concat(tokens, [8193::BIGINT, -100::BIGINT]) AS y FROM token_seqs),
flat AS (SELECT id, i - 1 AS pos, x[i] AS input, y[i] AS target FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM shaped))
"""

_MARK = (
    "ăâđêôơưàáảãạằắẳẵặèéẻẽẹìíỉĩịòóỏõọùúủũụỳýỷỹỵầấẩẫậềếểễệồốổỗộờớởỡợừứửữự"
)

# Texts and their readings, written by hand.
VI_CASES = {
    "Căn hộ 45m2": "Căn hộ bốn mươi lăm mét vuông",
    "ngày 3/4/2021": "ngày ba tháng bốn năm hai nghìn không trăm hai mươi mốt",
    "lúc 7h15 tối": "lúc bảy giờ mười lăm phút tối",
    "từ 1-3/2022": "từ tháng một đến tháng ba năm hai nghìn không trăm hai mươi hai",
    "rót 1/3 đến 2/3 ly": "rót một phần ba đến hai phần ba ly",
    "lịch chiếu 8/2 đến 9/3": "lịch chiếu ngày tám tháng hai đến ngày chín tháng ba",
    "giảm 5%": "giảm năm phần trăm",
    "máy bơm 2 pha": "máy bơm hai pha",
    "Q.3": "quận ba",
    "chương VII": "chương bảy",
    "10-12 ngày": "mười đến mười hai ngày",
    "Android 4.4": "Android bốn chấm bốn",
    "gọi 0987 654 321": "gọi không chín tám bảy sáu năm bốn ba hai một",
    "mã số: A1-23": "mã số: a một hai ba",
    "10³": "mười mũ ba",
    "2½ kg": "hai và một phần hai ki lô gam",
    "gõ a@b.vn": "gõ a@b.vn",
}

_SMALL = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "x x twenty thirty forty fifty sixty seventy eighty ninety".split()


def _listed(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_BELOW = f"""(CASE WHEN g >= 100 THEN {_listed(_SMALL)}[g // 100 + 1] || ' hundred' || CASE WHEN g % 100 > 0 THEN ' and ' ELSE '' END ELSE '' END
  || CASE WHEN g % 100 = 0 AND g > 0 THEN '' WHEN g % 100 < 20 THEN {_listed(_SMALL)}[g % 100 + 1]
     ELSE {_listed(_TENS)}[g % 100 // 10 + 1] || CASE WHEN g % 10 > 0 THEN '-' || {_listed(_SMALL)}[g % 10 + 1] ELSE '' END END)"""

_ENGLISH = f"""
WITH t AS (SELECT DISTINCT wav_path, norm_text FROM train WHERE lang = 'en'),
parts AS (SELECT wav_path, norm_text, regexp_split_to_array(norm_text, '\\p{{Nd}}+') AS between, regexp_extract_all(norm_text, '\\p{{Nd}}+') AS runs FROM t),
run AS (SELECT DISTINCT r, translate(r, '０１２３４５６７８９', '0123456789')::HUGEINT AS n FROM (SELECT unnest(runs) AS r FROM parts)),
grp AS (SELECT r, n, i, (n // power(1000, i)::HUGEINT % 1000)::INT AS g FROM (SELECT r, n, unnest(range(0, 7)) AS i FROM run)),
word AS (SELECT r, n, i, {_BELOW} || ['', ' thousand', ' million', ' billion', ' trillion', ' quadrillion', ' quintillion'][i + 1] AS w FROM grp WHERE g > 0 OR (n = 0 AND i = 0)),
said AS (SELECT r, list(w ORDER BY i DESC) AS ws, any_value(n) AS n FROM word GROUP BY r),
reading AS (SELECT r, CASE WHEN n >= 1000 AND n % 1000 BETWEEN 1 AND 99 THEN array_to_string(ws[:-2], ', ') || ' and ' || ws[-1] ELSE array_to_string(ws, ', ') END AS w FROM said),
piece AS (SELECT wav_path, norm_text, i, between[i] AS b, runs[i] AS r FROM (SELECT *, unnest(range(1, len(between) + 1)) AS i FROM parts))
SELECT wav_path, string_agg(b || coalesce(w, ''), '' ORDER BY i) AS form FROM piece LEFT JOIN reading USING (r) GROUP BY wav_path, norm_text
UNION ALL SELECT wav_path, NULL FROM t WHERE norm_text IS NULL"""

_DIGIT = _listed("không một hai ba bốn năm sáu bảy tám chín".split())
_VI_NUMBER = f"""
WITH n AS (SELECT DISTINCT r::BIGINT AS n FROM (SELECT unnest(regexp_extract_all(norm_text, '[0-9]+')) AS r FROM train) WHERE length(r) <= 18),
g AS (SELECT n, i, (n // power(10::HUGEINT, 3 * i)::HUGEINT % 1000)::INT AS g, i = (length(n::VARCHAR) - 1) // 3 AS first FROM (SELECT n, unnest(range(0, 6)) AS i FROM n)),
w AS (SELECT n, i, trim(
    CASE WHEN g >= 100 OR NOT first THEN {_DIGIT}[g // 100 + 1] || ' trăm ' ELSE '' END
    || CASE WHEN g % 100 = 0 THEN '' WHEN g % 100 < 10 THEN CASE WHEN g >= 100 OR NOT first THEN 'lẻ ' ELSE '' END || {_DIGIT}[g % 10 + 1]
       WHEN g % 100 < 20 THEN 'mười' || CASE g % 10 WHEN 0 THEN '' WHEN 5 THEN ' lăm' ELSE ' ' || {_DIGIT}[g % 10 + 1] END
       ELSE {_DIGIT}[g % 100 // 10 + 1] || ' mươi' || CASE g % 10 WHEN 0 THEN '' WHEN 1 THEN ' mốt' WHEN 4 THEN ' tư' WHEN 5 THEN ' lăm' ELSE ' ' || {_DIGIT}[g % 10 + 1] END END
    || ' ' || ['', 'nghìn', 'triệu', 'tỷ', 'nghìn tỷ', 'triệu tỷ'][i + 1]) AS w FROM g WHERE g > 0)
SELECT n.n, coalesce(string_agg(regexp_replace(w, ' +', ' ', 'g'), ' ' ORDER BY i DESC), 'không') AS reading FROM n LEFT JOIN w USING (n) GROUP BY n.n"""

_ASCII = "[!-~\\x00-\\x1f\\x7f]"
_CHINESE = _MAN.split(", judged AS")[0].replace("FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC) AS rn FROM manifest) WHERE rn = 1", "FROM manifest") + f"""
, t AS (SELECT DISTINCT id, norm_text, string_split(norm_text, '') AS c FROM man WHERE regexp_matches(norm_text, '[\\x{{4e00}}-\\x{{9fff}}]')),
b AS (SELECT id, array_to_string(list_transform(range(1, len(c) + 1), lambda i: CASE WHEN c[i] = ' ' AND NOT (coalesce(regexp_full_match(c[i - 1], '{_ASCII}'), false) AND i > 1
    AND coalesce(regexp_full_match(c[i + 1], '{_ASCII}'), false)) THEN '' ELSE c[i] END), '') AS t FROM t)
SELECT id, regexp_replace(replace(regexp_replace(replace(replace(replace(replace(t, '²', '平方'), '³', '立方'), '.', '。'), ' - ', '，'), '[（）【】`]', '', 'g'), '——', ' '), '[，,、]+$', '。') AS form FROM b"""

_ZH = "。？！；：.?!;"
_SEGMENTS = f"""
WITH RECURSIVE d AS (SELECT doc_id, text, CASE WHEN text <> '' AND NOT regexp_matches(text, '[{_ZH}]$') THEN text || '。' ELSE text END AS closed FROM documents
    WHERE regexp_matches(text, '[\\x{{4e00}}-\\x{{9fff}}]')),
whole AS (SELECT doc_id, regexp_extract_all(closed, '(?s:.)[^{_ZH}]*[{_ZH}]"?') AS p FROM d),
cut AS (SELECT doc_id, CASE WHEN len(p) = 1 AND length(p[1]) > 80 THEN list_transform(range(0, (length(p[1]) - 2) // 80 + 1), lambda i: substr(left(p[1], length(p[1]) - 1), i * 80 + 1, 80)) ELSE p END AS p FROM whole),
piece AS (SELECT doc_id, i, p[i] AS piece, length(p[i]) AS n FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM cut)),
walk AS (
  SELECT doc_id, i, 0 AS seg, n AS line FROM piece WHERE i = 1
  UNION ALL
  SELECT p.doc_id, p.i, seg + CASE WHEN line + n > 80 AND line > 60 THEN 1 ELSE 0 END, CASE WHEN line + n > 80 AND line > 60 THEN n ELSE line + n END
  FROM walk JOIN piece p ON p.doc_id = walk.doc_id AND p.i = walk.i + 1),
size AS (SELECT doc_id, seg, sum(n) AS n, seg = max(seg) OVER (PARTITION BY doc_id) AS last FROM walk JOIN piece USING (doc_id, i) GROUP BY doc_id, seg),
tail AS (SELECT w.doc_id, w.i, w.seg - CASE WHEN last AND size.n < 20 AND w.seg > 0 THEN 1 ELSE 0 END AS seg FROM walk w JOIN size ON size.doc_id = w.doc_id AND size.seg = w.seg),
line AS (SELECT doc_id, seg, regexp_replace(string_agg(piece, '' ORDER BY i), '[。；：.;]$', '') AS s FROM tail JOIN piece USING (doc_id, i) GROUP BY doc_id, seg),
kept AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seg) - 1 AS position, s AS segment FROM line WHERE NOT regexp_full_match(s, '[\\p{{P}}\\p{{S}}]*'))
SELECT doc_id, position, segment FROM kept UNION ALL SELECT doc_id, 0, text FROM d WHERE doc_id NOT IN (SELECT doc_id FROM kept)"""

# weights of the 64 samples in each of the three joins, the silence left out
_FADES = {
    "joined": "CASE WHEN i < 48 AND i % 16 = 14 THEN 1 WHEN i < 48 AND i % 16 = 15 THEN 0 WHEN i >= 16 AND i % 16 = 0 THEN 0 ELSE 1 END",
    "mixed": "CASE WHEN i < 12 THEN 1 - i / 11 WHEN i < 24 THEN (i - 12) / 11 ELSE 1 END",
    "edged": "CASE WHEN i < 3 THEN i / 2 WHEN i >= 61 THEN 1 - (i - 61) / 2 ELSE 1 END",
}
_DRAW = "('0x' || substr(md5(wav_path || ':7'), 1, 12))::BIGINT"

ORACLES = {
    "clean_text": f"SELECT DISTINCT id, {_NORM} AS norm_text, length({_NORM}) AS chars FROM manifest",
    "reject_reason": _MAN + "SELECT id, coalesce(reason, 'accepted') AS reason FROM judged",
    "reason_counts": _MAN + "SELECT coalesce(reason, 'accepted') AS reason, count(*) AS n FROM judged GROUP BY 1",
    "tier_filter": _META
    + """, there AS (
        SELECT meta.*, man.sr, coalesce('/srv/tts/s8_package/dataset/' || file_name IN (SELECT wav_path FROM train), false) OR file_name IN (SELECT wav_path FROM train) AS wav_exists
        FROM meta LEFT JOIN (SELECT id, arg_max(struct_pack(sr := sr), ingested_at).sr AS sr FROM manifest GROUP BY id) man ON man.id = meta.id)
      SELECT id, tier, wav_exists, sr, CASE WHEN tier NOT IN ('A', 'B') THEN 'tier_' || coalesce(nullif(tier, ''), 'missing')
      WHEN NOT wav_exists THEN 'audio_missing' WHEN norm_text = '' THEN 'empty_text' WHEN coalesce(speaker_id, '') = '' THEN 'speaker_missing'
      WHEN duration IS NULL THEN 'duration_missing' WHEN duration < 1.0 THEN 'too_short'
      WHEN duration > 30.0 OR duration * 50.0 > 1520 THEN 'too_long' WHEN sr < 22050 THEN 'sample_rate' ELSE 'accepted' END AS reason FROM there""",
    "packaged_coercion": _META + "SELECT id, duration, snr_db, dnsmos, cer, clipping, multi_speaker, tier, split FROM meta",
    "small_speaker_drop": _MAN + "SELECT speaker_id, count(*) AS n, count(*) < 2 AS dropped FROM passed GROUP BY speaker_id",
    "tier_speaker_counts": _MAN + f"SELECT upper({_strip('tier')}) AS tier, count(*) AS n, count(DISTINCT speaker_id) AS speakers FROM man GROUP BY 1",
    "quality_score": _MAN + "SELECT id, round(score, 6) AS score FROM man",
    "pick_refs": _REFS + "SELECT id, refs, ref_source FROM refs",
    "pick_refs_fallback": _REFS + "SELECT ref_source, count(*) AS n, sum(CASE WHEN refs = '' THEN 0 ELSE length(refs) - length(replace(refs, '|', '')) + 1 END)::BIGINT AS refs FROM refs GROUP BY 1",
    "split_field": _MAN + f"SELECT {_SPLIT} AS split, count(*) AS n FROM man GROUP BY 1",
    "split_hash": _MAN
    + """SELECT id, speaker_id, CASE WHEN rk <= (CASE WHEN n >= 10 THEN greatest(1, round_even(n * 0.02, 0)) WHEN n >= 4 THEN 1 ELSE 0 END) THEN 'val' ELSE 'train' END AS split
      FROM (SELECT id, speaker_id, n, row_number() OVER (PARTITION BY speaker_id ORDER BY md5(id || ':42'), id) AS rk FROM accepted)""",
    "split_sizes": _MAN
    + "SELECT speaker_id, count(*) AS n, (CASE WHEN count(*) >= 10 THEN greatest(1, round_even(count(*) * 0.05, 0)) WHEN count(*) >= 4 THEN 1 ELSE 0 END)::INT AS val FROM accepted GROUP BY speaker_id",
    "curation_summary": _FINAL
    + """SELECT count(*) AS accepted, count(DISTINCT speaker_id) AS speakers, round(coalesce(sum(duration), 0) / 3600, 3) AS hours_total,
      count(*) FILTER (part = 'train') AS train_utts, round(coalesce(sum(duration) FILTER (part = 'train'), 0) / 3600, 3) AS train_hours,
      count(*) FILTER (part = 'val') AS val_utts, round(coalesce(sum(duration) FILTER (part = 'val'), 0) / 3600, 3) AS val_hours,
      (SELECT count(*) FROM gone) AS rejected, (SELECT count(DISTINCT reason) FROM gone) AS reasons FROM kept""",
    "training_lines": _FINAL
    + "SELECT id, 'vi' || chr(9) || audio_path || chr(9) || norm_text || chr(9) || 'semantic/' || id || '.npy' || chr(9) || replace(refs, '|', ',') AS line FROM kept",
    "median_token_rate": _MAN
    + """SELECT round(median(n / duration), 6) AS median_rate, count(*) AS clips, abs(median(n / duration) - 50) / 50 > 0.2 AS alarm
      FROM (SELECT man.duration, t.n FROM man JOIN token_seqs t USING (id)) WHERE duration > 0 AND n > 0""",
    "resume_antijoin": _MAN + "SELECT id FROM man WHERE id NOT IN (SELECT id FROM token_seqs)",
    "existing_audio": """SELECT count(*) FILTER (wav_path IN (SELECT '/srv/tts/s8_package/dataset/' || file_name FROM metadata)) AS present, count(*) AS listed
      FROM (SELECT DISTINCT wav_path FROM train)""",
    "text_mismatches": _MAN
    + f""", packaged AS (SELECT {_STEM} AS id, text AS other FROM (SELECT *, row_number() OVER (PARTITION BY file_name ORDER BY exported_at DESC) AS k FROM metadata) WHERE k = 1)
      SELECT id, packaged.id IS NOT NULL AS packaged FROM man LEFT JOIN packaged USING (id) WHERE man.text IS DISTINCT FROM packaged.other""",
    "newest_checkpoints": r"""WITH f AS (SELECT DISTINCT 'runs/' || lang AS folder, regexp_extract(wav_path, '_(\d{8})_\d{8}', 1) AS step FROM train)
      SELECT folder, arg_max(folder || '/step_' || step || '.ckpt', step::BIGINT) AS path FROM f GROUP BY folder""",
    "upload_checks": _META
    + r"""SELECT CASE WHEN lower(regexp_extract(source_path, '(\.[^./]*)$', 1)) NOT IN ('.wav', '.flac', '.mp3', '.m4a', '.ogg') THEN 'suffix'
      WHEN coalesce(trunc(duration * 4000000), 0) = 0 THEN 'empty' WHEN trunc(duration * 4000000) > 52428800 THEN 'too_large' ELSE 'ok' END AS error, count(*) AS n FROM meta GROUP BY 1""",
    "interleave_langs": """WITH t AS (SELECT DISTINCT lang, wav_path FROM train),
      p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY wav_path) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS len FROM t),
      s AS (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS s, count(*) OVER () AS l, max(len) OVER () AS most, len FROM (SELECT DISTINCT lang, len FROM p)),
      r AS (SELECT i, i % l AS src, i // l AS at FROM (SELECT l, unnest(range(0, most * l)) AS i FROM (SELECT DISTINCT l, most FROM s)))
      SELECT i, p.lang, p.wav_path FROM r JOIN s ON s.s = r.src JOIN p ON p.lang = s.lang AND p.pos = r.at % s.len""",
    "val_batches": _MAN + f"SELECT id, k // 32 AS batch, k % 32 AS slot FROM (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM man WHERE {_SPLIT} = 'val')",
    "train_batches": _MAN
    + f"""SELECT batch, count(*) AS n, min(id) AS first, max(id) AS last
      FROM (SELECT id, k // 32 AS batch, total // 32 AS whole FROM (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k, count(*) OVER () AS total FROM man WHERE {_SPLIT} = 'train'))
      WHERE batch < whole GROUP BY batch""",
    "token_gate": "SELECT id, n, len(tokens) > 0 AND len(tokens) <= 1520 AND coalesce(list_max(tokens) < 8192, false) AS admitted FROM token_seqs",
    "pad_mask": """WITH t AS (SELECT len(tokens) AS n, (row_number() OVER (ORDER BY id) - 1) // 8 AS batch FROM token_seqs
        WHERE len(tokens) > 0 AND len(tokens) <= 1520 AND list_max(tokens) < 8192)
      SELECT batch, count(*) AS rows, max(n) + 2 AS width, sum(n + 2)::BIGINT AS real, sum(n + 1)::BIGINT AS labelled FROM t GROUP BY batch""",
    "label_shift": _TOKENS + "SELECT id, pos, input, target FROM flat",
    "cleaned_tokens": """WITH t AS (SELECT id, list_transform(list_filter(list_transform(tokens, lambda x: x + 700), lambda x: x NOT IN (8192, 8193)), lambda x: least(x, 8191)) AS t FROM token_seqs)
      SELECT id, len(t) AS n, list_max(t) AS top, coalesce(list_sum(t), 0)::BIGINT AS total FROM t""",
    "masked_accuracy": _TOKENS
    + "SELECT id, round(avg(CASE WHEN input % 2 = target % 2 THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(abs(input - target)), 6) AS l1 FROM flat WHERE target <> -100 GROUP BY id",
    "runs_by_mode": "SELECT mode, lang, count(*) AS n FROM (SELECT DISTINCT lang, norm_text FROM train) CROSS JOIN (VALUES ('clone'), ('continue')) AS m(mode) GROUP BY 1, 2",
    "speaker_sets": f"""WITH a AS (SELECT DISTINCT lower({_strip("speaker_id")}) AS s FROM manifest WHERE {_strip("speaker_id")} <> ''),
      b AS (SELECT DISTINCT lower({_strip("speaker_id")}) AS s FROM metadata WHERE {_strip("speaker_id")} <> '')
      SELECT 'both' AS part, count(*) AS n FROM (FROM a INTERSECT FROM b) UNION ALL SELECT 'manifest only', count(*) FROM (FROM a EXCEPT FROM b)""",
    "detect_lang": f"""SELECT DISTINCT id, CASE WHEN regexp_matches(text, '[\\x{{4e00}}-\\x{{9fff}}]') THEN 'zh' WHEN regexp_matches(lower(nfc_normalize(text)), '[{_MARK}]') THEN 'vi' ELSE 'en' END AS lang,
      regexp_full_match(text, '[\\p{{P}}\\p{{S}}]*') AS marks_only FROM manifest WHERE text IS NOT NULL""",
    "prompts": """WITH known AS (SELECT * FROM (VALUES ('vi', '越南语'), ('en', '英文'), ('zh', '中文'), ('ja', '日语'), ('fr', '法语'), ('de', '德语'), ('es', '西班牙语'), ('ru', '俄语')) AS k(lang, name))
      SELECT DISTINCT wav_path, 'You are a helpful assistant. 请用' || coalesce(name, t.lang) || '朗读接下来的文字:' || norm_text AS prompt,
        CASE WHEN regexp_full_match(norm_text, '[\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]*') THEN 'blank_text' WHEN length(norm_text) > 1024 THEN 'text_too_long' WHEN name IS NULL THEN 'language_not_served' ELSE 'ok' END AS request
      FROM train t LEFT JOIN known USING (lang)""",
    "continuation_prompts": f"""WITH said AS (SELECT wav_path AS ref, min(norm_text) AS spoken FROM train GROUP BY 1),
      first AS (SELECT wav_path, norm_text, list_filter(string_split(coalesce(ref_audio_paths, ''), ','), lambda x: x <> '')[1] AS ref FROM train)
      SELECT DISTINCT wav_path, (CASE WHEN p <> '' AND NOT regexp_matches(p, '[.?!;:。？！]$') THEN p || '.' ELSE p END) || ' ' || t AS prompt
      FROM (SELECT wav_path, regexp_replace(spoken, '^{_SPACE}|{_SPACE}$', '', 'g') AS p, regexp_replace(norm_text, '^{_SPACE}|{_SPACE}$', '', 'g') AS t FROM first JOIN said USING (ref))""",
    "tokens_per_word": _MAN
    + f"""SELECT id, w AS words, round(n / greatest(w, 1), 6) AS rate
      FROM (SELECT man.id, t.n, len(list_filter(regexp_split_to_array(norm_text, '{_SPACE}'), lambda x: x <> '')) AS w FROM man JOIN token_seqs t USING (id))""",
    "l2_cosine": _VEC
    + f""", m AS (SELECT label, i, avg(v[i]) AS m FROM (SELECT label, v, unnest(range(1, 65)) AS i FROM vec) GROUP BY 1, 2),
      c AS (SELECT label, list(m ORDER BY i) AS c FROM m GROUP BY label)
      SELECT vec_id, round({_NORM2.format('v')}, 6) AS norm, round(list_dot_product(v, c) / ({_NORM2.format('v')} * {_NORM2.format('c')}), 6) AS cosine FROM vec JOIN c USING (label)""",
    "norm_quantiles": _VEC
    + f"""SELECT label, round(quantile_cont(n, 0.1), 6) AS p10, round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.9), 6) AS p90, round(avg(n), 6) AS mean
      FROM (SELECT label, {_NORM2.format('v')} AS n FROM vec) GROUP BY label""",
    "zscore": _VEC
    + """, flat AS (SELECT vec_id, i - 1 AS i, v[i] AS x FROM (SELECT vec_id, v, unnest(range(1, 65)) AS i FROM vec)),
      st AS (SELECT i, avg(x) AS m, var_pop(x) AS s FROM flat GROUP BY i) SELECT vec_id, i, round((x - m) / sqrt(s), 6) AS z FROM flat JOIN st USING (i)""",
    "blend": _VEC
    + f""", b AS (SELECT vec_id, list_transform(range(1, 65), lambda i: 0.5 * v[i] + 0.5 * v[65 - i]) AS b, (SELECT avg({_NORM2.format('v')}) FROM vec) AS target FROM vec),
      r AS (SELECT vec_id, list_transform(b, lambda x: x * (target / greatest({_NORM2.format('b').replace('lambda x: x * x', 'lambda y: y * y')}, 1e-8))) AS r FROM b)
      SELECT vec_id, round(r[1], 6) AS first, round({_NORM2.format('r')}, 6) AS norm FROM r""",
    "mean_subtraction": _VEC
    + """, flat AS (SELECT vec_id, i - 1 AS i, v[i] AS x FROM (SELECT vec_id, v, unnest(range(1, 65)) AS i FROM vec)),
      d AS (SELECT vec_id, i, x - avg(x) OVER (PARTITION BY vec_id, i % 8) AS x FROM flat) SELECT vec_id, i, round(x, 6) AS x, round(ln(greatest(abs(x), 1e-5)), 5) AS log FROM
      (SELECT vec_id, i, x FROM d)""",
    "pooled_stats": _VEC
    + """, w AS (SELECT vec_id, i, v[i] AS x, exp(3 * v[i] - 3 * list_max(v)) AS e FROM (SELECT vec_id, v, unnest(range(1, 65)) AS i FROM vec)),
      m AS (SELECT vec_id, sum(e * x) / sum(e) AS mean FROM w GROUP BY vec_id)
      SELECT vec_id, round(any_value(mean), 6) AS mean, round(sqrt(greatest(sum(e * (x - mean) * (x - mean)) / sum(e), 1e-12)), 6) AS std FROM w JOIN m USING (vec_id) GROUP BY vec_id""",
    "ema": _VEC
    + "SELECT vec_id, round(sum(v[i] * (CASE WHEN i = 1 THEN 1.0 ELSE 0.1 END) * pow(0.9, 64 - i)), 6) AS ema FROM (SELECT vec_id, v, unnest(range(1, 65)) AS i FROM vec) GROUP BY vec_id",
    "nearest_resample": _VEC + "SELECT vec_id, i, round(v[(i * 64) // 110 + 1], 6) AS x FROM (SELECT vec_id, v, unnest(range(0, 110)) AS i FROM vec)",
    "pcm_quantize": _VEC + "SELECT vec_id, i, trunc(greatest(-1.0, least(1.0, v[i + 1] * 2.0)) * 32767)::SMALLINT AS sample FROM (SELECT vec_id, v, unnest(range(0, 64)) AS i FROM vec)",
    "gathered_mean": """WITH size AS (SELECT count(*) AS k FROM embeddings), hits AS (SELECT id, unnest(tokens) % (SELECT k FROM size) AS vec_id FROM token_seqs WHERE n > 0)
      SELECT id, count(*) AS found, round(avg(embedding[1]::DOUBLE), 6) AS m0, round(avg(embedding[64]::DOUBLE), 6) AS m63 FROM hits JOIN embeddings USING (vec_id) GROUP BY id""",
    "count_chunks": _CHUNKS + "SELECT id, n, count(*) AS chunks, count(*) FILTER (is_final) AS final FROM chunk GROUP BY 1, 2",
    "overlap_slices": _CHUNKS + 'SELECT id, chunk_idx, start, end_ AS "end", floor((end_ - start) * 1.72::DOUBLE)::INT AS frames FROM chunk',
    "final_flush": _CHUNKS + 'SELECT id, start, end_ AS "end" FROM chunk WHERE is_final',
    "curation_report": _FINAL
    + """, n AS (SELECT count(*) AS accepted, count(DISTINCT speaker_id) AS speakers, round(coalesce(sum(duration), 0) / 3600, 3) AS hours_total,
        count(*) FILTER (part = 'train') AS train_utts, round(coalesce(sum(duration) FILTER (part = 'train'), 0) / 3600, 3) AS train_hours,
        count(*) FILTER (part = 'val') AS val_utts, round(coalesce(sum(duration) FILTER (part = 'val'), 0) / 3600, 3) AS val_hours,
        (SELECT count(*) FROM gone) AS rejected, (SELECT count(DISTINCT reason) FROM gone) AS reasons FROM kept)
      SELECT 'total' AS section, name, value FROM (SELECT accepted::DOUBLE AS accepted, speakers::DOUBLE AS speakers, hours_total::DOUBLE AS hours_total, train_utts::DOUBLE AS train_utts,
        train_hours::DOUBLE AS train_hours, val_utts::DOUBLE AS val_utts, val_hours::DOUBLE AS val_hours, rejected::DOUBLE AS rejected, reasons::DOUBLE AS reasons FROM n) UNPIVOT (value FOR name IN (*))
      UNION ALL SELECT 'rejected', reason, count(*)::DOUBLE FROM gone GROUP BY reason UNION ALL SELECT 'speaker', speaker_id, count(*)::DOUBLE FROM kept GROUP BY speaker_id""",
    "reference_choice": f"""WITH t AS (SELECT DISTINCT wav_path, list_filter(string_split(coalesce(ref_audio_paths, ''), ','), lambda x: x <> '') AS refs FROM train)
      SELECT ({_DRAW} % 4)::INT AS rank, count(*) AS n, count(*) FILTER (len(refs) > 0) AS with_ref, count(*) FILTER (list_contains(refs, refs[{_DRAW} % greatest(len(refs), 1) + 1])) AS valid
      FROM t GROUP BY 1""",
    "chinese_form": _CHINESE,
    "english_numbers": _ENGLISH,
    "vi_number": _VI_NUMBER,
    "vi_normalize_cases": "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in VI_CASES.items()) + ") AS t(text, reading)",
    "segment_zh": _SEGMENTS,
    "crossfade": _VEC
    + f""", flat AS (SELECT vec_id, i, v[i + 1] AS x FROM (SELECT vec_id, v, unnest(range(0, 64))::DOUBLE AS i FROM (SELECT vec_id, v FROM vec)))
      SELECT vec_id, 70 AS joined_n, 52 AS mixed_n, 70 AS edged_n, {", ".join(f"round(sum(x * ({w})), 5) AS {n}_sum" for n, w in _FADES.items())} FROM flat GROUP BY vec_id""".replace("v[i + 1]", "v[i::INT + 1]"),
    "nucleus": _VEC
    + """, s AS (SELECT vec_id, i, CASE WHEN i % 7 <> 0 THEN x WHEN x < 0 THEN x * 1.3 ELSE x / 1.3 END AS x FROM (SELECT vec_id, i, v[i + 1] AS x FROM (SELECT vec_id, v, unnest(range(0, 64)) AS i FROM vec))),
      p AS (SELECT vec_id, i, exp(x) / sum(exp(x)) OVER (PARTITION BY vec_id) AS q FROM s),
      r AS (SELECT *, row_number() OVER w AS k, coalesce(sum(q) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p WINDOW w AS (PARTITION BY vec_id ORDER BY q DESC, i))
      SELECT vec_id, count(*) AS kept, min(i) FILTER (k = 1) AS likeliest FROM r WHERE k <= 20 AND before < 0.3 GROUP BY vec_id""",
    "calibrated_scale": _VEC
    + f"SELECT round(avg(n) FILTER (vec_id % 2 = 0) / avg(n) FILTER (vec_id % 2 = 1), 4) AS scale FROM (SELECT vec_id, {_NORM2.format('v')} AS n FROM vec)",
    "vector_bytes": """SELECT label::INT AS label, sum(len(embedding))::BIGINT AS parameters, sum(len(embedding))::BIGINT * 4 AS bytes FROM embeddings GROUP BY label
      UNION ALL SELECT NULL, sum(len(embedding))::BIGINT, sum(len(embedding))::BIGINT * 4 FROM embeddings""",
    "cross_entropy": _VEC
    + """, f AS (SELECT vec_id, label, ln(list_sum(list_transform(v[1:10], lambda x: exp(x)))) - v[label + 1] AS loss FROM vec WHERE label < 10)
      SELECT round(avg(loss), 6) AS loss, count(loss) AS counted FROM f""",
    "mel_frames": """SELECT id, (CASE WHEN n > 0 THEN n // 64 + 1 ELSE 0 END)::INT AS mel_frames, (CASE WHEN n >= 400 THEN (n - 400) // 160 + 1 ELSE 0 END)::INT AS bank_frames, true AS whole
      FROM (SELECT id, len(tokens) AS n FROM token_seqs)""",
    "normalize_by_language": """WITH t AS (SELECT DISTINCT wav_path, norm_text, lang FROM train WHERE norm_text IS NOT NULL),
      k AS (SELECT lang, CASE WHEN lower(lang) IN ('zh', 'vi', 'ja') THEN lower(lang) WHEN lower(lang) <> 'auto' THEN 'en'
        WHEN regexp_matches(norm_text, '[\\x{4e00}-\\x{9fff}]') THEN 'zh' WHEN regexp_matches(lower(nfc_normalize(norm_text)), '[MARKS]') THEN 'vi' ELSE 'en' END AS language FROM t)
      SELECT lang, language, count(*) AS n, 0 AS english_with_digits FROM k GROUP BY 1, 2""".replace("MARKS", _MARK).replace("\\\\", "\\"),
    "streamed_chunks": """WITH s AS (SELECT id, len(tokens) AS n, range(40, len(tokens) // 40 * 40 + 1, 80) AS e FROM token_seqs),
      p AS (SELECT id, n, CASE WHEN n < 25 AND n > 0 THEN [{'e': n, 'f': true}] WHEN n < 40 AND n > 0 THEN [{'e': n, 'f': false}] WHEN n = 0 THEN []
        ELSE list_concat(list_transform(e, lambda x: {'e': x, 'f': false}), CASE WHEN n > e[-1] THEN [{'e': n, 'f': n - e[-1] < 50}] ELSE [] END) END AS c FROM s)
      SELECT id AS seq_id, (i - 1)::INT AS chunk_idx, greatest(0, coalesce(CASE WHEN i > 1 THEN c[i - 1].e END, 0) - 10)::INT AS start, c[i].e::INT AS "end", c[i].f AS is_final
      FROM (SELECT id, c, unnest(range(1, len(c) + 1)) AS i FROM p)""",
}
