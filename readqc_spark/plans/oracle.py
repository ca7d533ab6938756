"""DuckDB SQL for the engine's queries, formulated base by base, apart from the array form that Spark runs."""

from __future__ import annotations

from readqc_spark.plans.simulated import BASES, CIGARS, LETTERS, SPANS

_CIGAR = ", ".join(f"'{c}'" for c, _ in CIGARS)
_LEN, _SPAN = ", ".join(str(n) for _, n in CIGARS), ", ".join(map(str, SPANS))
_VIEWS = f"""
contigs AS MATERIALIZED (SELECT 'ctg' || doc_id AS chr, doc_id, seq, length(seq)::INT AS length FROM (SELECT doc_id, regexp_replace(translate(lower(text), '{LETTERS}', '{BASES}'), '[^ACGTN]', '', 'g') AS seq FROM documents) WHERE length(seq) >= 200),
a0 AS (SELECT *, doc_id * 4 + k AS aln_id, CASE WHEN k = 3 THEN length - ([{_SPAN}])[1 + (doc_id + k) % {len(CIGARS)}] + 1 ELSE 1 + (doc_id * 13 + k * 37) % (length - 120) END::INT AS pos, ([{_CIGAR}])[1 + (doc_id + k) % {len(CIGARS)}] AS cigar, ([{_LEN}])[1 + (doc_id + k) % {len(CIGARS)}]::INT AS n FROM contigs, (SELECT unnest([0, 1, 2, 3]) AS k)),
alns AS MATERIALIZED (SELECT aln_id, 'read' || aln_id AS read_name, ((k % 2) * 16 + CASE WHEN aln_id % 11 = 0 THEN 2048 ELSE 0 END + CASE WHEN aln_id % 13 = 0 THEN 256 ELSE 0 END + CASE WHEN aln_id % 17 = 0 THEN 4 ELSE 0 END)::INT AS flags, chr, pos, CASE WHEN aln_id % 7 <> 0 THEN aln_id % 61 END::INT AS mapq, cigar, rpad(substr(seq, pos, n), n, 'G') AS seq, n,
  CASE WHEN aln_id % 5 <> 0 THEN (aln_id % 40) / 4.0 END::DOUBLE AS ec, (1 + aln_id % 15)::INT AS np, CASE WHEN aln_id % 3 <> 0 THEN (aln_id % 1024) / 1024.0 END::DOUBLE AS rq FROM a0),
bed AS (SELECT chr, (50 * j + 1)::INT AS start, (50 * j + 31 + 10 * (j % 3))::INT AS stop, 'f' || (j % 4) AS feature FROM contigs, range(0, 100000) r(j) WHERE 50 * j < length),
toks AS (SELECT aln_id, pos, unnest(regexp_extract_all(cigar, '[0-9]+[A-Z=]')) AS t, generate_subscripts(regexp_extract_all(cigar, '[0-9]+[A-Z=]'), 1) - 1 AS op_i FROM alns),
ops0 AS (SELECT aln_id, pos, op_i, right(t, 1) AS op, left(t, length(t) - 1)::INT AS len FROM toks),
ops AS MATERIALIZED (SELECT aln_id, op_i::INT AS op_i, op, len, (pos + coalesce(sum(CASE WHEN op IN ('M', '=', 'X', 'D', 'N') THEN len ELSE 0 END) OVER w, 0))::INT AS ref_start, (1 + coalesce(sum(CASE WHEN op IN ('M', '=', 'X', 'I', 'S') THEN len ELSE 0 END) OVER w, 0))::INT AS query_start FROM ops0 WINDOW w AS (PARTITION BY aln_id ORDER BY op_i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
spans AS (SELECT aln_id, sum(CASE WHEN op IN ('M', '=', 'X', 'D', 'N') THEN len ELSE 0 END)::INT AS span FROM ops GROUP BY 1),
m AS MATERIALIZED (SELECT a.*, c.seq AS contig, c.length AS contig_length, pos + span AS aln_end, (flags & 16) <> 0 AS rev, (flags & 2048) <> 0 AS supp FROM alns a JOIN spans USING (aln_id) JOIN contigs c USING (chr) WHERE (flags & 260) = 0),
per_base AS (SELECT aln_id, op, ref_start + j AS p, query_start + j AS q FROM ops, range(0, 100) r(j) WHERE j < len AND op IN ('M', '=', 'X', 'D')),
bases AS (SELECT b.*, m.supp, substr(contig, p::BIGINT, 1) AS r, CASE WHEN p > 1 THEN substr(contig, p - 1, 1) ELSE '' END AS r0, substr(contig, p + 1, 1) AS r1, substr(seq, q, 1) AS s, 2 + (aln_id * 7 + q * 13) % 40 AS qual FROM per_base b JOIN m USING (aln_id)),
ins AS (SELECT o.aln_id, m.supp, ref_start AS p, len AS n, (x = repeat(substr(contig, ref_start, 1), len) OR x = repeat(substr(contig, ref_start + 1, 1), len)) AS hp FROM (SELECT o.*, substr(a.seq, query_start, len) AS x FROM ops o JOIN alns a USING (aln_id) WHERE op = 'I' AND len > 0) o JOIN m USING (aln_id)),
ev AS MATERIALIZED (
  SELECT aln_id, supp, CASE WHEN op = '=' OR (op = 'M' AND r = s) THEN 'match' ELSE 'mismatch' END AS kind, false AS hp, 1 AS n, p::INT AS ref_pos, qual::INT AS qual, CASE WHEN r IN ('C', 'G') THEN 1 ELSE 0 END AS gc FROM bases WHERE op <> 'D'
  UNION ALL SELECT aln_id, supp, 'del', r = r0 OR r = r1, 1, p::INT, NULL, CASE WHEN r IN ('C', 'G') THEN 1 ELSE 0 END FROM bases WHERE op = 'D'
  UNION ALL SELECT aln_id, supp, 'ins', hp, n, p, NULL, 0 FROM ins),
cnt AS (SELECT aln_id, sum(CASE WHEN kind = 'match' THEN n ELSE 0 END)::BIGINT AS matches, sum(CASE WHEN kind = 'mismatch' THEN n ELSE 0 END)::BIGINT AS mismatches, sum(CASE WHEN kind = 'ins' AND NOT hp THEN n ELSE 0 END)::BIGINT AS non_hp_ins, sum(CASE WHEN kind = 'del' AND NOT hp THEN n ELSE 0 END)::BIGINT AS non_hp_del, sum(CASE WHEN kind = 'ins' AND hp THEN n ELSE 0 END)::BIGINT AS hp_ins, sum(CASE WHEN kind = 'del' AND hp THEN n ELSE 0 END)::BIGINT AS hp_del, sum(gc)::BIGINT AS gc FROM ev GROUP BY 1),
gaps AS (SELECT aln_id, count(*) FILTER (op = 'I') AS gap_ins, count(*) FILTER (op = 'D') AS gap_del FROM ops GROUP BY 1),
mq AS (SELECT aln_id, round(-10 * log10(avg(pow(10.0, -(2 + (aln_id * 7 + i * 13) % 40) / 10.0))))::INT AS mean_qual FROM alns, range(1, 121) r(i) WHERE i <= n GROUP BY 1),
st0 AS (SELECT m.*, c.* EXCLUDE (aln_id), gap_ins, gap_del, mean_qual, mismatches + non_hp_ins + non_hp_del + hp_ins + hp_del AS errors, matches + mismatches + non_hp_del + hp_del AS bases FROM m JOIN cnt c USING (aln_id) JOIN gaps USING (aln_id) JOIN mq USING (aln_id)),
st AS MATERIALIZED (SELECT *, gc / bases AS gc_content, matches / (matches + errors) AS concordance, CASE WHEN errors > 0 THEN -10 * log10(1 - matches / (matches + errors)) ELSE 75.0 END AS qv FROM st0),
pr AS (SELECT * FROM st WHERE NOT supp),
iw(aln_id, supp, start, stop, feature_key) AS (SELECT aln_id, supp, (CASE WHEN rev THEN greatest(aln_end - o - 20, pos) ELSE pos + o END)::INT, (CASE WHEN rev THEN aln_end - o ELSE least(pos + o + 20, aln_end) END)::INT, 'window_20' FROM m, range(0, 120, 20) r(o) WHERE o < aln_end - pos),
iwp(aln_id, supp, start, stop, feature_key) AS (SELECT aln_id, supp, (CASE WHEN rev THEN greatest(aln_end - o - 25, pos) ELSE pos + o END)::INT, (CASE WHEN rev THEN aln_end - o ELSE least(pos + o + 25, aln_end) END)::INT, 'window_25_pos_' || o FROM m, range(0, 125, 25) r(o) WHERE o < aln_end - pos),
ib(aln_id, supp, start, stop, feature_key) AS (SELECT aln_id, supp, greatest(b - 2, pos)::INT, least(b + 2, aln_end)::INT, 'border_15' FROM (SELECT *, CASE WHEN rev THEN aln_end - o ELSE pos + o END AS b FROM m, range(15, 120, 15) r(o) WHERE o < aln_end - pos)),
im(aln_id, supp, start, stop, feature_key) AS (SELECT aln_id, supp, i::INT, (i + 3)::INT, 'ACG' FROM m, range(0, 120) r(j), LATERAL (SELECT pos + j AS i) WHERE i + 3 <= aln_end AND substr(contig, i, 3) = CASE WHEN rev THEN 'CGT' ELSE 'ACG' END),
hb AS (SELECT aln_id, supp, rev, pos + j AS p, substr(contig, pos + j, 1) AS r FROM m, range(0, 120) r(j) WHERE pos + j < aln_end),
hr AS (SELECT *, p - row_number() OVER (PARTITION BY aln_id, r ORDER BY p) AS run FROM hb),
ih(aln_id, supp, start, stop, feature_key) AS (SELECT aln_id, any_value(supp), min(p)::INT, (max(p) + 1)::INT, lpad(count(*)::VARCHAR, 5, ' ') || CASE WHEN any_value(rev) THEN translate(r, 'ACGTN', 'TGCAN') ELSE r END FROM hr GROUP BY aln_id, r, run HAVING count(*) >= 2),
io(aln_id, supp, start, stop, feature_key) AS (SELECT aln_id, supp, b.start, b.stop, feature FROM m JOIN bed b ON m.chr = b.chr AND b.start < aln_end AND b.stop > pos),
iv AS (SELECT * FROM ih UNION ALL SELECT * FROM iw UNION ALL SELECT * FROM iwp UNION ALL SELECT * FROM ib UNION ALL SELECT * FROM im UNION ALL SELECT * FROM io),
ivn AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY aln_id, start, stop, feature_key) AS id FROM iv),
stab AS (SELECT i.id, i.feature_key, e.* FROM ivn i JOIN ev e ON i.aln_id = e.aln_id AND e.ref_pos >= i.start AND e.ref_pos < i.stop),
bad AS (SELECT DISTINCT id FROM stab WHERE kind <> 'match')
"""
_COUNTS = ("matches", "mismatches", "non_hp_ins", "non_hp_del", "hp_ins", "hp_del")
_IVCOLS = "aln_id, start, stop, feature_key"
_KBP = ", ".join(f"round({c} / b * 1000, 6) AS {c}_per_kbp" for c in _COUNTS)
_PER = ", ".join(f"round({c} / intervals, 6) AS {c}_per_interval" for c in _COUNTS)
_SUMS = ", ".join(f"sum({c})::BIGINT AS {c}" for c in _COUNTS)
_KINDS = ", ".join(f"coalesce(sum(n) FILTER ({w}), 0)::BIGINT AS {c}" for c, w in zip(_COUNTS, ("kind = 'match'", "kind = 'mismatch'", "kind = 'ins' AND NOT hp", "kind = 'del' AND NOT hp", "kind = 'ins' AND hp", "kind = 'del' AND hp"), strict=True))
_ERR = "(mismatches + non_hp_ins + non_hp_del + hp_ins + hp_del)"
_QV = "CASE WHEN matches / (matches + err) <> 1 THEN -10 * log10(1 - matches / (matches + err)) ELSE 75.0 END"


def _bin(kind: str, step: str, value: str) -> str:
    return f"SELECT bin_type, bin, num_reads, b AS num_bases, round(matches / (matches + err), 6) AS identity, round({_QV}, 6) AS identity_qv, {_KBP} FROM (SELECT *, {_ERR} AS err, matches + mismatches + non_hp_del + hp_del AS b FROM (SELECT '{kind}:{step}' AS bin_type, {value} AS bin, count(*) AS num_reads, {_SUMS} FROM pr GROUP BY 1, 2))"


_SELECTS = {
    "src_contigs": "SELECT chr, length, md5(seq) AS seq_md5 FROM contigs",
    "src_alignments": "SELECT aln_id, read_name, flags, chr, pos, coalesce(mapq, 255) AS mapq, cigar, seq, array_to_string(list_transform(range(1, n + 1), lambda i: 2 + (aln_id * 7 + i * 13) % 40), ',') AS quals FROM alns",
    "src_bed": "SELECT * FROM bed",
    "aln_optional_tags": "SELECT aln_id, ec, np, rq FROM alns",
    "out_name_column": "SELECT 'sample' AS name, aln_id, read_name FROM alns",
    "filter_mapped_primary": "SELECT aln_id, flags FROM alns WHERE (flags & 4) = 0 AND (flags & 256) = 0",
    "filter_supplementary": "SELECT aln_id, flags FROM m WHERE NOT supp",
    "aln_projection": "SELECT aln_id, read_name, chr, pos, n AS q_len, CASE WHEN supp THEN 'supplementary' ELSE 'primary' END AS alignment_type, CASE WHEN rev THEN '-' ELSE '+' END AS strand, coalesce(mapq, 255) AS mapq FROM m",
    "cigar_span": "SELECT aln_id, span, sum(CASE WHEN op IN ('M', '=', 'X', 'I', 'S') THEN len ELSE 0 END)::INT AS query_length FROM ops JOIN spans USING (aln_id) GROUP BY ALL",
    "cigar_coords": "SELECT aln_id, op_i, op, len, ref_start, query_start FROM ops",
    "base_match_mismatch": "SELECT aln_id, kind, count(*) AS n, sum(ref_pos)::BIGINT AS places, sum(qual)::BIGINT AS quals FROM ev WHERE kind IN ('match', 'mismatch') GROUP BY 1, 2",
    "ins_homopolymer": "SELECT aln_id, p AS ref_pos, n, hp FROM ins",
    "del_homopolymer": "SELECT aln_id, ref_pos, hp FROM ev WHERE kind = 'del'",
    "gap_compressed": "SELECT aln_id, gap_ins, gap_del, round(matches / (matches + mismatches + gap_ins + gap_del), 6) AS concordance_gc FROM st",
    "aln_gc_content": "SELECT aln_id, round(gc_content, 6) AS gc_content FROM st",
    "aln_counts": f"SELECT aln_id, {', '.join(_COUNTS)} FROM cnt",
    "aln_stats_table": "SELECT aln_id, bases AS read_len, round(bases / contig_length, 6) AS ref_cov, round(gc_content, 6) AS gc_content, round(concordance, 6) AS concordance, round(matches / (matches + mismatches + gap_ins + gap_del), 6) AS concordance_gc, round(qv, 6) AS concordance_qv, mean_qual, errors FROM st",
    "aln_mean_qual": "SELECT aln_id, mean_qual FROM mq",
    "join_contig": "SELECT aln_id, contig_length, substr(contig, greatest(pos - 1, 1), aln_end - greatest(pos - 1, 1) + 3) AS slice FROM m",
    "join_contig_broadcast": "SELECT aln_id, contig_length, substr(contig, greatest(pos - 1, 1), aln_end - greatest(pos - 1, 1) + 3) AS slice FROM m",
    **dict.fromkeys(("src_fasta", "src_fasta_gz"), "SELECT chr, length, md5(seq) AS seq_md5 FROM contigs"),
    "src_bed_file": "SELECT * FROM bed",
    **dict.fromkeys(("src_sam", "src_bam"), "SELECT read_name, flags, chr, pos, coalesce(mapq, 255) AS mapq, cigar, seq, array_to_string(list_transform(range(1, n + 1), lambda i: 2 + (aln_id * 7 + i * 13) % 40), ',') AS quals, coalesce(ec, -1) AS ec, np, coalesce(rq, -1) AS rq FROM alns"),
    "join_bed_overlap": f"SELECT {_IVCOLS} FROM io",
    "intervals_bed": "SELECT feature_key, count(*) AS intervals, sum(start)::BIGINT AS starts, sum(stop)::BIGINT AS stops FROM io GROUP BY 1",
    "join_base_interval": "SELECT feature_key, kind, count(*) AS hits, sum(ref_pos)::BIGINT AS places FROM stab GROUP BY 1, 2",
    "identical_intervals": "SELECT feature_key, count(*) AS intervals, count(*) FILTER (id NOT IN (SELECT id FROM bad)) AS identical FROM ivn GROUP BY 1",
    **{f"intervals_{n}": f"SELECT {_IVCOLS} FROM {t}" for n, t in (("homopolymer", "ih"), ("window", "iw"), ("window_pos", "iwp"), ("border", "ib"), ("match", "im"))},
    "intervals_union": "SELECT feature_key, count(*) AS n, sum(stop - start)::BIGINT AS bases FROM iv GROUP BY 1",
    "fn_revcomp": "SELECT aln_id, reverse(translate(seq, 'ACGTN', 'TGCAN')) AS revcomp FROM alns",
    "fn_phred": "SELECT q::INT AS q, round(pow(10.0, -q / 10.0) * 1e6, 6) AS error_ppm, round(-10 * log10(pow(10.0, -q / 10.0)), 6) AS back FROM range(0, 94) r(q)",
    "fn_concordance_qv": "SELECT aln_id, round(qv, 6) AS concordance_qv FROM st",
    "fn_rates": "SELECT aln_id, bases AS num_bases, errors, round(matches / bases * 1000, 6) AS matches_per_kbp, round(concordance, 6) AS identity FROM st",
    "summary_yield": "SELECT t::INT AS min_empirical_q, count(aln_id) AS yield_reads, coalesce(sum(n), 0)::BIGINT AS yield_bases FROM range(0, 75, 5) r(t) LEFT JOIN pr ON qv >= t GROUP BY 1",
    "summary_identity": f"SELECT (SELECT count(*) FROM alns) AS total_alns, primary_alns, round(matches / (matches + err), 6) AS identity, round(CASE WHEN err > 0 THEN -10 * log10(1 - matches / (matches + err)) ELSE 75.0 END, 6) AS identity_qv, round(matches / (matches + mismatches + gi + gd), 6) AS gap_compressed_identity, {_KBP} FROM (SELECT *, {_ERR} AS err, matches + mismatches + non_hp_del + hp_del AS b FROM (SELECT count(*) AS primary_alns, {_SUMS}, sum(gap_ins) AS gi, sum(gap_del) AS gd FROM pr))",
    "summary_cigar": "SELECT cigar, length, count, round(count / sum(count) OVER (PARTITION BY cigar), 6) AS length_count_per_cigar FROM (SELECT op AS cigar, len AS length, count(*) AS count FROM ops JOIN pr USING (aln_id) WHERE op IN ('=', 'X', 'M', 'I', 'D') GROUP BY 1, 2)",
    "summary_feature": f"SELECT trim(feature_key) AS feature, intervals, round(same / intervals, 6) AS identical_intervals, round(matches / (matches + err), 6) AS identity, round({_QV}, 6) AS identity_qv, round(-10 * log10(qe / (matches + mismatches)), 6) AS mean_qual, round((matches + mismatches + non_hp_del + hp_del) / intervals, 6) AS bases_per_interval, {_PER} FROM (SELECT feature_key, count(*) AS intervals, count(*) FILTER (id NOT IN (SELECT id FROM bad)) AS same FROM ivn WHERE NOT supp GROUP BY 1) JOIN (SELECT *, {_ERR} AS err FROM (SELECT feature_key, {_KINDS}, sum(pow(10.0, -qual / 10.0)) FILTER (kind IN ('match', 'mismatch')) AS qe FROM stab WHERE NOT supp GROUP BY 1)) USING (feature_key)",
    "summary_qual_score": "SELECT trim(f) AS feature, qual AS qual_score, round(CASE WHEN m <> t THEN -10 * log10(1 - m / t) ELSE 75.0 END, 6) AS empirical_qv FROM (SELECT f, qual, count(*) FILTER (kind = 'match') AS m, count(*) AS t FROM (SELECT 'all_alignments' AS f, qual, kind FROM ev WHERE NOT supp AND qual IS NOT NULL UNION ALL SELECT x.feature_key, e.qual, e.kind FROM (SELECT * FROM iw UNION ALL SELECT * FROM ih) x JOIN ev e ON x.aln_id = e.aln_id AND e.ref_pos >= x.start AND e.ref_pos < x.stop WHERE NOT e.supp AND qual IS NOT NULL) GROUP BY 1, 2)",
    "summary_bin_q_len": _bin("q_len", "10", "(n // 10 * 10)::DOUBLE"),
    "summary_bin_passes": _bin("subread_passes", "4", "(np // 4 * 4)::DOUBLE"),
    "summary_bin_mapq": _bin("mapq", "7", "(coalesce(mapq, 255) // 7 * 7)::DOUBLE"),
    "summary_bin_mean_qual": _bin("mean_qual", "2", "(mean_qual // 2 * 2)::DOUBLE"),
    "summary_bin_gc": _bin("gc_content", "0.125", "floor(gc_content / 0.125::DOUBLE) * 0.125::DOUBLE"),
    "summary_bin_qv": _bin("concordance_qv", "0.5", "floor(qv / 0.5::DOUBLE) * 0.5::DOUBLE"),
}
ORACLE = {name: f"WITH {_VIEWS} {select}" for name, select in _SELECTS.items()}
