"""DuckDB SQL that several oracles share: greedy folds as recursive queries."""

from __future__ import annotations

from ..sources import adapter as A
from .scalars import COLOURS

#: From ``first_use(drawing_id, r, g, b, ordinal)`` to ``fold(drawing_id, i, r, g, b, reps, colour_no)``.
LAB_SQL = """lin AS (SELECT *, CASE WHEN r <= 0.04045 THEN r/12.92 ELSE pow((r+0.055)/1.055, 2.4) END AS lr, CASE WHEN g <= 0.04045 THEN g/12.92 ELSE pow((g+0.055)/1.055, 2.4) END AS lg, CASE WHEN b <= 0.04045 THEN b/12.92 ELSE pow((b+0.055)/1.055, 2.4) END AS lb FROM first_use),
xyz AS (SELECT *, (lr*0.4124564 + lg*0.3575761 + lb*0.1804375)/0.95047 AS x, lr*0.2126729 + lg*0.7151522 + lb*0.0721750 AS y, (lr*0.0193339 + lg*0.1191920 + lb*0.9503041)/1.08883 AS z FROM lin),
fx AS (SELECT *, CASE WHEN x > 0.008856 THEN cbrt(x) ELSE x*7.787 + 16.0/116.0 END AS f1, CASE WHEN y > 0.008856 THEN cbrt(y) ELSE y*7.787 + 16.0/116.0 END AS f2, CASE WHEN z > 0.008856 THEN cbrt(z) ELSE z*7.787 + 16.0/116.0 END AS f3 FROM xyz),
co AS (SELECT drawing_id, r, g, b, f2*116 - 16 AS l, (f1-f2)*500 AS aa, (f2-f3)*200 AS bb, row_number() OVER (PARTITION BY drawing_id ORDER BY ordinal) AS i FROM fx),
fold AS (SELECT drawing_id, i, r, g, b, [{'l': l, 'a': aa, 'b': bb}] AS reps, 0::BIGINT AS colour_no FROM co WHERE i = 1
  UNION ALL SELECT co.drawing_id, co.i, co.r, co.g, co.b, CASE WHEN len(list_filter(reps, lambda p: sqrt((p.l-co.l)*(p.l-co.l)+(p.a-co.aa)*(p.a-co.aa)+(p.b-co.bb)*(p.b-co.bb)) < 5)) = 0 THEN list_append(reps, {'l': co.l, 'a': co.aa, 'b': co.bb}) ELSE reps END,
   coalesce(list_min(list_filter(list_transform(reps, lambda p, k: CASE WHEN sqrt((p.l-co.l)*(p.l-co.l)+(p.a-co.aa)*(p.a-co.aa)+(p.b-co.bb)*(p.b-co.bb)) < 5 THEN k - 1 END), lambda v: v IS NOT NULL)), len(reps)) FROM fold JOIN co ON co.drawing_id = fold.drawing_id AND co.i = fold.i + 1)"""
COLOUR_SQL = f"WITH RECURSIVE first_use AS (SELECT p_partkey % 16 AS drawing_id, r, g, b, min(colour_id) AS ordinal FROM ({A.rows_sql('part', COLOURS)}) JOIN part ON p_partkey = colour_id GROUP BY ALL), {LAB_SQL}\nSELECT drawing_id, r, g, b, colour_no::INT AS colour_no FROM fold"

#: Boxes of every drawing merged in up to three passes: from ``pn(drawing_id, ordinal, x0, y0, x1, y1)`` to ``merged(drawing_id, out)``. A step takes one box and folds all later ones into it.
_AREA = "greatest(0, {b}.x1 - {b}.x0) * greatest(0, {b}.y1 - {b}.y0)"
_COMMON = "greatest(0, least(acc.x1, o.x1) - greatest(acc.x0, o.x0)) * greatest(0, least(acc.y1, o.y1) - greatest(acc.y0, o.y0)) > 0.5::DOUBLE * least(" + _AREA.format(b="acc") + ", " + _AREA.format(b="o") + ")"
_FOLDED = f"""list_reduce(list_transform(todo[2:], lambda o: {{'x0': o.x0, 'y0': o.y0, 'x1': o.x1, 'y1': o.y1, 'rest': []::STRUCT(x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE)[]}}),
  lambda acc, o: CASE WHEN {_COMMON} THEN {{'x0': least(acc.x0, o.x0), 'y0': least(acc.y0, o.y0), 'x1': greatest(acc.x1, o.x1), 'y1': greatest(acc.y1, o.y1), 'rest': acc.rest}} ELSE {{'x0': acc.x0, 'y0': acc.y0, 'x1': acc.x1, 'y1': acc.y1, 'rest': list_append(acc.rest, {{'x0': o.x0, 'y0': o.y0, 'x1': o.x1, 'y1': o.y1}})}} END,
  {{'x0': todo[1].x0, 'y0': todo[1].y0, 'x1': todo[1].x1, 'y1': todo[1].y1, 'rest': []::STRUCT(x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE)[]}})"""
MERGE_SQL = f"""mg AS (SELECT drawing_id, 1 AS pass, list({{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}} ORDER BY ordinal) AS todo, []::STRUCT(x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE)[] AS out, count(*) AS before, false AS done FROM pn GROUP BY drawing_id
  UNION ALL SELECT drawing_id, CASE WHEN len(todo) = 0 THEN pass + 1 ELSE pass END, CASE WHEN len(todo) = 0 THEN out ELSE f.rest END, CASE WHEN len(todo) = 0 THEN []::STRUCT(x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE)[] ELSE list_append(out, {{'x0': f.x0, 'y0': f.y0, 'x1': f.x1, 'y1': f.y1}}) END,
    CASE WHEN len(todo) = 0 THEN len(out) ELSE before END, len(todo) <= 1 AND len(f.rest) = 0 AND (pass = 3 OR len(out) + 1 = before)
  FROM (SELECT *, CASE WHEN len(todo) > 0 THEN {_FOLDED} END AS f FROM mg WHERE NOT done)),
merged AS (SELECT drawing_id, out FROM mg WHERE done)"""

#: Candidates of a drawing settled one by one: from ``cand(drawing_id, i, a, a_end, b, b_end, gap)`` to ``kept(drawing_id, a, a_end, b, b_end, gap)``.
_ROOT = "coalesce(list_filter(roots, lambda z: z.n = c.{x})[1].r, c.{x})"
SETTLE_SQL = f"""gs AS (SELECT DISTINCT drawing_id, 0::BIGINT AS i, []::BIGINT[] AS used, []::STRUCT(n BIGINT, r BIGINT)[] AS roots, false AS took, NULL::BIGINT AS a, NULL::INT AS a_end, NULL::BIGINT AS b, NULL::INT AS b_end, NULL::DOUBLE AS gap FROM cand
  UNION ALL SELECT drawing_id, i, CASE WHEN ok THEN list_concat(used, [a * 2 + a_end, b * 2 + b_end]) ELSE used END,
    CASE WHEN ok THEN list_transform(list_concat(list_filter(roots, lambda z: z.n <> a AND z.n <> b), [{{'n': a, 'r': ra}}, {{'n': b, 'r': rb}}]), lambda z: {{'n': z.n, 'r': CASE WHEN z.r = greatest(ra, rb) THEN least(ra, rb) ELSE z.r END}}) ELSE roots END, ok, a, a_end, b, b_end, gap
  FROM (SELECT gs.drawing_id, c.i, used, roots, c.a, c.a_end, c.b, c.b_end, c.gap, {_ROOT.format(x="a")} AS ra, {_ROOT.format(x="b")} AS rb, NOT list_contains(used, c.a * 2 + c.a_end) AND NOT list_contains(used, c.b * 2 + c.b_end) AND {_ROOT.format(x="a")} <> {_ROOT.format(x="b")} AS ok FROM gs JOIN cand c ON c.drawing_id = gs.drawing_id AND c.i = gs.i + 1)),
kept AS (SELECT drawing_id, a, a_end, b, b_end, gap FROM gs WHERE took)"""

#: Shapes put to letters in order: from ``shapes(drawing_id, i, lo, hi, ratio, n)`` (lo, hi: bits as text) to ``lf(drawing_id, i, ..., letter)``.
_NEAR = "abs(p.r - s.ratio) <= 0.35::DOUBLE AND bit_count(xor(p.lo, s.lo)) + bit_count(xor(p.hi, s.hi)) <= 9"
LETTER_SQL = f"""lf AS (SELECT drawing_id, i, lo, hi, ratio, n, [{{'lo': lo, 'hi': hi, 'r': ratio}}] AS letters, 0::BIGINT AS letter FROM shapes WHERE i = 1
  UNION ALL SELECT s.drawing_id, s.i, s.lo, s.hi, s.ratio, s.n, CASE WHEN len(list_filter(letters, lambda p: {_NEAR})) = 0 THEN list_append(letters, {{'lo': s.lo, 'hi': s.hi, 'r': s.ratio}}) ELSE letters END,
    coalesce(list_min(list_filter(list_transform(letters, lambda p, k: CASE WHEN {_NEAR} THEN k - 1 END), lambda v: v IS NOT NULL)), len(letters)) FROM lf JOIN shapes s ON s.drawing_id = lf.drawing_id AND s.i = lf.i + 1)"""
