"""The banded model as SQL that recurs over the rows of a band: what the array form is held against on whole tables."""

from __future__ import annotations

from ..functions.scalars import EXTEND_DELETION, EXTEND_INSERTION, OPEN_DELETION, OPEN_INSERTION

MI, MD, II, DD = OPEN_INSERTION, OPEN_DELETION, EXTEND_INSERTION, EXTEND_DELETION
MM, IM, DM = 1 - MI - MD, 1 - II, 1 - DD


def at(values: str, place: str, n: str) -> str:
    """Value ``place``, from 0, of a list of ``n``; 0 beyond its ends."""
    return f"(CASE WHEN ({place}) >= 0 AND ({place}) < {n} THEN {values}[({place}) + 1] ELSE 0.0 END)"


def emit(k: str, j: str) -> str:
    """Chance of the k-th placed base before reference prefix j."""
    return f"(CASE WHEN {j} < 1 OR {j} > 120 THEN 0.0 WHEN substr(r.bases, CAST({k} AS BIGINT), 1) NOT IN ('A', 'C', 'G', 'T') THEN 0.25 WHEN substr(r.bases, CAST({k} AS BIGINT), 1) = substr(r.ref, CAST({j} AS BIGINT), 1) THEN r.same ELSE r.other END)"


#: Bands of reads, the recurrences forward and backward row by row, and each read's window of sums, at a half-width of 2.
B5 = f"""
lead AS (SELECT rec_no, CAST(sum(len) FILTER (op = 'S' AND i = 1) AS BIGINT) AS s FROM raw_offs GROUP BY 1),
place AS (SELECT rec_no, 0 AS i, pos AS f FROM mapped WHERE ok UNION ALL
  SELECT o.rec_no, q0 - coalesce(s, 0) + j + 1, CASE WHEN op = 'M' THEN r0 + j + 1 ELSE r0 END FROM raw_offs o JOIN lead USING (rec_no), unnest(range(0, o.len)) AS t(j) WHERE op IN ('M', 'I')),
jump AS (SELECT o.rec_no, q0 - coalesce(s, 0) AS i, max(r0 + o.len) AS l FROM raw_offs o JOIN lead USING (rec_no) WHERE op = 'D' GROUP BY 1, 2),
bands AS (SELECT rec_no, list(f - 2 ORDER BY i) AS low, list(coalesce(l, f) - f + 5 ORDER BY i) AS w, max(i) AS n FROM place LEFT JOIN jump USING (rec_no, i) GROUP BY 1),
rd AS MATERIALIZED (SELECT rec_no, m.tid, low, w, b.n, substr(m.seq, coalesce(s, 0) + 1) AS bases, refs.seq AS ref, 0.995 * (1 - e) + 0.005 * e / 3 AS same, 0.995 * e / 3 + 0.005 * (1 - e / 3) / 3 AS other, e
  FROM (SELECT *, least(0.75, power(10.0, -q / 10.0)) AS e FROM mapped WHERE ok) m JOIN bands b USING (rec_no) JOIN lead USING (rec_no) JOIN refs ON refs.tid = m.tid),
fwd AS (
  SELECT rec_no, CAST(0 AS BIGINT) AS i, list_transform(range(0, w[1]), lambda c: CAST(1.0 / w[1] AS DOUBLE)) AS fm, list_transform(range(0, w[1]), lambda c: CAST(0 AS DOUBLE)) AS fi, list_transform(range(0, w[1]), lambda c: CAST(0 AS DOUBLE)) AS fd, CAST(1 AS DOUBLE) AS s FROM rd
  UNION ALL
  SELECT rec_no, i, list_transform(m, lambda x: x * s), list_transform(ins, lambda x: x * s), list_transform(gap, lambda x: x * s), s FROM (
    SELECT *, CASE WHEN list_sum(m) + list_sum(ins) + list_sum(gap) > 0 THEN 1 / (list_sum(m) + list_sum(ins) + list_sum(gap)) END AS s FROM (
      SELECT *, list_transform(range(0, len(m)), lambda c: CASE WHEN i < n AND c > 0 THEN {MD} * list_sum(list_transform(range(0, c), lambda k: m[k + 1] * power({DD}, c - 1 - k))) ELSE 0.0 END) AS gap FROM (
        SELECT f.rec_no, f.i + 1 AS i, r.n,
          list_transform(range(0, r.w[f.i + 2]), lambda c: {emit('f.i + 1', '(r.low[f.i + 2] + c)')} * ({MM} * {at('f.fm', 'r.low[f.i + 2] + c - 1 - r.low[f.i + 1]', 'r.w[f.i + 1]')} + {IM} * {at('f.fi', 'r.low[f.i + 2] + c - 1 - r.low[f.i + 1]', 'r.w[f.i + 1]')} + {DM} * {at('f.fd', 'r.low[f.i + 2] + c - 1 - r.low[f.i + 1]', 'r.w[f.i + 1]')})) AS m,
          list_transform(range(0, r.w[f.i + 2]), lambda c: 0.25 * ({MI} * {at('f.fm', 'r.low[f.i + 2] + c - r.low[f.i + 1]', 'r.w[f.i + 1]')} + {II} * {at('f.fi', 'r.low[f.i + 2] + c - r.low[f.i + 1]', 'r.w[f.i + 1]')})) AS ins
        FROM fwd f JOIN rd r USING (rec_no) WHERE f.i < r.n)))
    WHERE s IS NOT NULL),
whole AS MATERIALIZED (SELECT rec_no, list(s ORDER BY i) AS scales FROM fwd GROUP BY rec_no),
rs AS MATERIALIZED (SELECT rd.*, scales FROM rd JOIN whole USING (rec_no) WHERE len(scales) = n + 1),
bwd AS (
  SELECT rec_no, CAST(n AS BIGINT) AS i, list_transform(range(0, w[n + 1]), lambda c: CAST(1 AS DOUBLE)) AS bm, list_transform(range(0, w[n + 1]), lambda c: CAST(1 AS DOUBLE)) AS bi, list_transform(range(0, w[n + 1]), lambda c: CAST(0 AS DOUBLE)) AS bd, list_transform(range(0, w[n + 1]), lambda c: CAST(0 AS DOUBLE)) AS p FROM rs
  UNION ALL
  SELECT rec_no, i, list_transform(range(0, len(p)), lambda c: {MM} * p[c + 1] + {MI} * q[c + 1] + {MD} * coalesce(gap[c + 2], 0.0)), list_transform(range(0, len(p)), lambda c: {IM} * p[c + 1] + {II} * q[c + 1]), gap, p FROM (
    SELECT *, list_transform(range(0, len(p)), lambda c: CASE WHEN i > 0 THEN {DM} * list_sum(list_transform(range(c, len(p)), lambda k: p[k + 1] * power({DD}, k - c))) ELSE 0.0 END) AS gap FROM (
      SELECT b.rec_no, b.i - 1 AS i,
        list_transform(range(0, r.w[b.i]), lambda c: r.scales[b.i + 1] * {emit('b.i', '(r.low[b.i] + c + 1)')} * {at('b.bm', 'r.low[b.i] + c + 1 - r.low[b.i + 1]', 'r.w[b.i + 1]')}) AS p,
        list_transform(range(0, r.w[b.i]), lambda c: r.scales[b.i + 1] * 0.25 * {at('b.bi', 'r.low[b.i] + c - r.low[b.i + 1]', 'r.w[b.i + 1]')}) AS q
      FROM bwd b JOIN rs r USING (rec_no) WHERE b.i > 0))),
cell AS (SELECT r.rec_no, r.tid, r.low[f.i + 1] + c - 1 AS pos, f.fm[c + 1] * b.bm[c + 1] AS hit, f.fd[c + 1] * b.bd[c + 1] AS skip, {DM} * f.fd[c + 1] * b.p[c + 1] AS closed, substr(r.bases, CAST(f.i AS BIGINT), 1) AS x, substr(r.ref, CAST(r.low[f.i + 1] + c AS BIGINT), 1) AS y, same, other, e
  FROM fwd f JOIN bwd b USING (rec_no, i) JOIN rs r USING (rec_no), unnest(range(0, r.w[f.i + 1])) AS t(c) WHERE f.i > 0),
win AS (SELECT rec_no, tid, pos, sum(hit) AS cov, sum(hit + skip) AS spn, sum(closed + hit * CASE WHEN x NOT IN ('A', 'C', 'G', 'T') OR y NOT IN ('A', 'C', 'G', 'T') THEN 0.0 WHEN x = y THEN 0.005 * e / 3 / same ELSE 0.005 * (1 - e / 3) / 3 / other END) AS mut
  FROM cell WHERE pos >= 0 AND pos < 120 GROUP BY ALL)
"""
