"""The derived library, its signatures and pair rules, as DuckDB SQL."""

from __future__ import annotations

from twinlake import config as C

_CLIP = "CAST(greatest(0, least(255, floor({}))) AS INTEGER)"
_BRIGHT = "CAST(least(255, {0} * 108 // 100) AS INTEGER)"
_CELL = "e[((y // 2) * 8 + x // 2 + {}) % 64 + 1]"


def _three(form: str) -> str:
    return ", ".join(f"{form.format(c)} AS {c}" for c in "rgb")


PARTS: dict[str, tuple[str, str]] = {
    "v": ("", "SELECT vec_id AS v, CAST(embedding AS DOUBLE[]) AS e FROM embeddings"),
    "grid": ("", "SELECT y, x FROM (SELECT unnest(range(16)) AS y), (SELECT unnest(range(16)) AS x)"),
    "orig": (
        "v grid",
        "SELECT v, y, x, "
        + _CLIP.format(f"100 + 40 * (v % 3) + 220 * {_CELL.format(0)} + 10 * ((v // 3) % 5)") + " AS r, "
        + _CLIP.format(f"100 + 40 * (v % 3) + 220 * {_CELL.format(21)}") + " AS g, "
        + _CLIP.format(f"100 + 40 * (v % 3) + 220 * {_CELL.format(42)} - 8 * ((v // 15) % 5)") + " AS b FROM v, grid",
    ),
    "pix": (
        "orig",
        "SELECT 8 * v AS asset_id, -1 AS f, y, x, r, g, b FROM orig"
        f" UNION ALL SELECT 8 * v + 1, -1, y, x, {_three(_BRIGHT)} FROM orig WHERE v % 7 = 0"
        f" UNION ALL SELECT 8 * v + 2, -1, y, x, {_three('CAST(least(255, {0} // 8 * 8 + 4) AS INTEGER)')} FROM orig WHERE v % 7 = 0"
        " UNION ALL SELECT 8 * v + 3, -1, 15 - x, y, r, g, b FROM orig WHERE v % 11 = 0"
        " UNION ALL SELECT 8 * v + 4, -1, y, x, r * 88 // 100, g * 97 // 100, b FROM orig WHERE v % 5 = 0"
        " UNION ALL SELECT 8 * v + 5, -1, y, x, 2, 2, 2 FROM orig WHERE v % 97 = 0"
        " UNION ALL SELECT 8 * v + 6, -1, y, CASE WHEN y < 6 THEN 15 - x ELSE x END, r, g, b FROM orig WHERE v % 13 = 0"
        " UNION ALL SELECT 8 * (v - k) + 7, k, y, x, r, g, b FROM orig, range(5) t(k) WHERE (v - k) % 10 = 3 AND v - k >= 0"
        f" UNION ALL SELECT 8 * (v - k) + 8000007, k, y, x, {_three(_BRIGHT)} FROM orig, range(5) t(k) WHERE (v - k) % 30 = 3 AND v - k >= 0",
    ),
    "lum": ("pix", "SELECT *, CAST(299 * r + 587 * g + 114 * b AS BIGINT) AS l FROM pix"),
    "cell": (
        "lum",
        "SELECT asset_id, f, y // 2 AS gy, [0,1,1,2,2,3,3,4,5,5,6,6,7,7,8,8][x + 1] AS gx, sum(l) AS s, count(*) AS n FROM lum GROUP BY ALL",
    ),
    "bits": (
        "cell",
        "SELECT a.asset_id, a.f, sum(CASE WHEN a.s * c.n < c.s * a.n THEN 1::HUGEINT << CAST(a.gy * 8 + a.gx AS INTEGER) ELSE 0 END) AS h"
        " FROM cell a JOIN cell c ON a.asset_id = c.asset_id AND a.f = c.f AND a.gy = c.gy AND c.gx = a.gx + 1 GROUP BY ALL",
    ),
    "dh": (
        "bits",
        "SELECT asset_id, f, CAST(CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END AS BIGINT) AS dhash FROM bits",
    ),
    "bins": (
        "pix",
        "SELECT asset_id, f, bin, count(*) AS n FROM (SELECT asset_id, f, CASE WHEN r + g + b < 30 THEN 36 ELSE"
        " least(7, 8 * r // greatest(1, r + g + b)) * 8 + least(7, 8 * g // greatest(1, r + g + b)) END AS bin FROM pix) GROUP BY ALL",
    ),
    "hist": (
        "bins",
        "SELECT asset_id, f, list(CAST(n AS INTEGER) ORDER BY bin) AS histogram FROM ("
        "SELECT asset_id, f, bin, sum(n) AS n FROM (SELECT * FROM bins UNION ALL"
        " SELECT i.asset_id, i.f, k, 0 FROM (SELECT DISTINCT asset_id, f FROM bins) i, range(64) t(k)) GROUP BY ALL) GROUP BY ALL",
    ),
    "shp": (
        "lum",
        "SELECT asset_id, f, list(d ORDER BY half, y, x) AS shape, CAST(sum(d * d) AS BIGINT) AS shape_norm FROM ("
        "SELECT a.asset_id, a.f, 0 AS half, a.y, a.x, c.l - a.l AS d FROM lum a JOIN lum c ON a.asset_id = c.asset_id AND a.f = c.f AND a.y = c.y AND c.x = a.x + 1"
        " UNION ALL SELECT a.asset_id, a.f, 1, a.y, a.x, c.l - a.l FROM lum a JOIN lum c ON a.asset_id = c.asset_id AND a.f = c.f AND c.y = a.y + 1 AND a.x = c.x)"
        " GROUP BY ALL",
    ),
    "sharp": (
        "lum",
        "SELECT asset_id, f, greatest(0, q / n - (s / n) * (s / n)) / (255000.0::DOUBLE * 255000) * 1000 AS sharpness FROM ("
        "SELECT m.asset_id, m.f, CAST(count(*) AS DOUBLE) AS n, CAST(sum(d) AS DOUBLE) AS s, CAST(sum(d * d) AS DOUBLE) AS q FROM ("
        "SELECT m.asset_id, m.f, 4 * m.l - u.l - o.l - w.l - z.l AS d FROM lum m"
        " JOIN lum u ON u.asset_id = m.asset_id AND u.f = m.f AND u.y = m.y - 1 AND u.x = m.x"
        " JOIN lum o ON o.asset_id = m.asset_id AND o.f = m.f AND o.y = m.y + 1 AND o.x = m.x"
        " JOIN lum w ON w.asset_id = m.asset_id AND w.f = m.f AND w.y = m.y AND w.x = m.x - 1"
        " JOIN lum z ON z.asset_id = m.asset_id AND z.f = m.f AND z.y = m.y AND z.x = m.x + 1) m GROUP BY ALL)",
    ),
    "tonal": (
        "lum",
        "SELECT asset_id, f, bucket, n, sum(n) OVER (PARTITION BY asset_id, f ORDER BY bucket) AS upto FROM ("
        "SELECT asset_id, f, l // 1000 AS bucket, count(*) AS n FROM lum GROUP BY ALL)",
    ),
    "tone": (
        "tonal lum",
        "SELECT asset_id, f, clipped, low, high, least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.6::DOUBLE * greatest(0, 1 - 1.5::DOUBLE * clipped)"
        " + 0.4::DOUBLE * least(1, (high - low) / 255.0::DOUBLE / 0.8::DOUBLE))) AS exposure FROM ("
        "SELECT asset_id, f, coalesce(sum(n) FILTER (bucket <= 1 OR bucket >= 254), 0) / 256.0::DOUBLE AS clipped,"
        " min(bucket) FILTER (upto >= 12) AS low, min(bucket) FILTER (upto >= 243) AS high FROM tonal GROUP BY ALL)",
    ),
    "mean": ("lum", "SELECT asset_id, f, CAST(sum(l) AS DOUBLE) / (255000.0::DOUBLE * 256) AS mean_luma FROM lum GROUP BY ALL"),
    "keys": (
        "dh",
        "SELECT asset_id, list(dhash ORDER BY f) AS keyframes, list(f ORDER BY f)[len(list(f)) // 2 + 1] AS middle FROM dh WHERE f >= 0 GROUP BY asset_id",
    ),
    "sig": (
        "dh hist shp sharp tone mean keys",
        "SELECT asset_id, dhash, histogram, shape, shape_norm, sharpness, exposure, mean_luma, coalesce(keyframes, []) AS keyframes"
        " FROM dh JOIN hist USING (asset_id, f) JOIN shp USING (asset_id, f) JOIN sharp USING (asset_id, f) JOIN tone USING (asset_id, f)"
        " JOIN mean USING (asset_id, f) LEFT JOIN keys USING (asset_id) WHERE f = coalesce(middle, -1)",
    ),
    "variants": (
        "v",
        "SELECT v, 0 AS k, 0 AS far FROM v"
        + "".join(f" UNION ALL SELECT v, {k}, 0 FROM v WHERE v % {m} = 0" for k, m in ((1, 7), (2, 7), (3, 11), (4, 5), (5, 97), (6, 13)))
        + " UNION ALL SELECT v, 7, 0 FROM v WHERE v % 10 = 3 UNION ALL SELECT v, 7, 8000000 FROM v WHERE v % 30 = 3",
    ),
    "records": (
        "variants",
        "SELECT 8 * v + k + far AS asset_id, CASE WHEN k = 7 THEN 3 WHEN v % 20 = 1 THEN 1 WHEN v % 20 = 2 THEN 2 ELSE 0 END AS kind,"
        " CASE WHEN k = 3 THEN h ELSE w END AS pixel_width, CASE WHEN k = 3 THEN w ELSE h END AS pixel_height,"
        " CASE WHEN v % 29 <> 0 THEN ts + to_seconds(20 * k) END AS creation_ts, CAST(NULL AS TIMESTAMP) AS modification_ts,"
        " CASE WHEN k = 7 THEN value + CASE WHEN far > 0 THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END ELSE 0.0::DOUBLE END AS duration,"
        " v % 17 = 0 AND k = 1 AS is_favorite, CASE WHEN v % 14 = 0 THEN 'b' || v END AS burst_id,"
        " v % 23 = 0 AND k = 2 AS is_edited, v % 19 = 0 AS is_hdr FROM ("
        "SELECT *, (CASE v % 3 WHEN 0 THEN 4032 WHEN 1 THEN 1920 ELSE 3000 END) // (CASE WHEN k IN (1, 2) THEN 2 ELSE 1 END) AS w,"
        " (CASE v % 3 WHEN 0 THEN 3024 WHEN 1 THEN 1080 ELSE 3000 END) // (CASE WHEN k IN (1, 2) THEN 2 ELSE 1 END) AS h"
        " FROM variants LEFT JOIN (SELECT event_id, ts, value FROM events) ON event_id = v)",
    ),
    "assets": (
        "records",
        "SELECT *, CAST(CASE kind WHEN 3 THEN floor(duration * 1.2e6 * greatest(0.25::DOUBLE, CAST(px AS DOUBLE) / 2073600))"
        " WHEN 1 THEN floor(px * 0.15::DOUBLE) WHEN 2 THEN floor(px * 0.30::DOUBLE) + 1800000 ELSE floor(px * 0.30::DOUBLE) END AS BIGINT) AS byte_size"
        " FROM (SELECT *, CAST(pixel_width AS BIGINT) * pixel_height AS px,"
        " CAST(greatest(pixel_width, pixel_height) AS DOUBLE) / least(pixel_width, pixel_height) AS aspect FROM records)",
    ),
    "lib": ("assets sig", "SELECT * FROM assets JOIN sig USING (asset_id)"),
}
_SIM = "list_sum(list_transform(list_zip(a.histogram, c.histogram), lambda z: least(z[1], z[2]))) / 256.0::DOUBLE"
_HAMMING = "bit_count(xor({}, {}))"
_ASPECT = "abs(a.aspect - c.aspect) / greatest(a.aspect, c.aspect) <= {}::DOUBLE"
_COSINE = (
    "list_dot_product(CAST({0}.shape AS DOUBLE[]), CAST({1}.shape AS DOUBLE[]))"
    " / sqrt(CAST({0}.shape_norm AS DOUBLE) * CAST({1}.shape_norm AS DOUBLE))"
)


def _required(s: str, t: C.Thresholds) -> str:
    a, f, k = (f"{x}::DOUBLE" for x in (t.histogram_accept, t.histogram_floor, t.shape_accept))
    return (
        f"CASE WHEN {s} >= {a} THEN {k} ELSE {k} + least(1.0::DOUBLE, greatest(0.0::DOUBLE, ({a} - {s}) / ({a} - {f}))) * ({C.SHAPE_COPY}::DOUBLE - {k}) END"
    )


def _accepts(t: C.Thresholds) -> str:
    return (
        f"(CASE WHEN ka = 1 AND kc = 1 THEN d <= {C.SCREENSHOT_HASH} AND s >= {C.SCREENSHOT_HISTOGRAM}::DOUBLE"
        f" ELSE (d <= {t.hash_accept} AND s >= {t.histogram_accept}::DOUBLE) OR (s >= {t.strong_histogram}::DOUBLE AND d <= {t.colour_led_hash}) END)"
    )


def level_parts(level: str) -> dict[str, tuple[str, str]]:
    """Pair rules of one sensitivity; names end in the level."""
    t, n, z = C.LEVELS[level], C.ANYTIME[level], level
    conf = "least(1.0::DOUBLE, 0.35::DOUBLE * greatest(0.0::DOUBLE, 1 - d / 32.0::DOUBLE) + 0.65::DOUBLE * s)"
    flat = f"(la < {C.DARK} OR la > {C.BRIGHT} OR lc < {C.DARK} OR lc > {C.BRIGHT})"
    moment = f"coalesce(abs(epoch(ta) - epoch(tc)) <= {C.SAME_MOMENT_S}, FALSE)" if level == "similar" else "FALSE"
    return {
        f"stills_{z}": (
            "lib",
            f"SELECT * FROM (SELECT a.asset_id AS id_lo, c.asset_id AS id_hi, CAST({_HAMMING.format('a.dhash', 'c.dhash')} AS INTEGER) AS d, {_SIM} AS s"
            f" FROM lib a JOIN lib c ON a.asset_id < c.asset_id WHERE a.kind <> 3 AND c.kind <> 3 AND abs(a.mean_luma - c.mean_luma) <= {C.LUMA_TOLERANCE}::DOUBLE"
            f" AND {_ASPECT.format(t.aspect_tolerance)} AND {_HAMMING.format('a.dhash', 'c.dhash')} <= {t.hash_reject}) WHERE s >= {t.histogram_floor}::DOUBLE",
        ),
        f"videos_{z}": (
            "lib",
            "SELECT id_lo, id_hi, CAST(round(m) AS INTEGER) AS d, s FROM (SELECT a.asset_id AS id_lo, c.asset_id AS id_hi,"
            " list_sum(list_transform(list_zip(a.keyframes, c.keyframes), lambda q: CAST(bit_count(xor(q[1], q[2])) AS INTEGER)))"
            f" / CAST(len(a.keyframes) AS DOUBLE) AS m, {_SIM} AS s FROM lib a JOIN lib c ON a.asset_id < c.asset_id WHERE a.kind = 3 AND c.kind = 3"
            " AND len(a.keyframes) = len(c.keyframes) AND abs(trunc(a.duration) - trunc(c.duration)) <= 1 AND (abs(a.duration - c.duration) <= 1"
            f" OR abs(a.duration - c.duration) / greatest(a.duration, c.duration, 0.001) <= {C.DURATION_SHARE}::DOUBLE)) WHERE m <= {t.video_hash_accept}",
        ),
        f"cand_{z}": (f"stills_{z} videos_{z}", f"SELECT * FROM stills_{z} UNION ALL SELECT * FROM videos_{z}"),
        f"both_{z}": (
            f"cand_{z} lib",
            "SELECT p.*, a.kind AS ka, c.kind AS kc, a.mean_luma AS la, c.mean_luma AS lc, a.creation_ts AS ta, c.creation_ts AS tc"
            f" FROM cand_{z} p JOIN lib a ON a.asset_id = id_lo JOIN lib c ON c.asset_id = id_hi",
        ),
        f"routes_{z}": (
            f"both_{z}",
            f"SELECT id_lo, id_hi, d, s, route, CASE route WHEN 'degenerate' THEN {C.DEGENERATE_CONFIDENCE}::DOUBLE WHEN 'direct' THEN {conf}"
            f" WHEN 'moment' THEN least({C.MOMENT_CONFIDENCE}::DOUBLE, {conf}) END AS confidence,"
            f" CASE route WHEN 'grey_moment' THEN {_required('s', t)} WHEN 'grey' THEN {_required('s', n)} END AS accept"
            f" FROM (SELECT *, CASE WHEN {flat} THEN CASE WHEN d = 0 AND s >= {C.DEGENERATE_HISTOGRAM}::DOUBLE THEN 'degenerate' END"
            f" WHEN {_accepts(n)} THEN 'direct' WHEN {moment} AND {_accepts(t)} THEN 'moment' WHEN ka = 3 OR kc = 3 THEN NULL"
            f" WHEN {moment} THEN 'grey_moment' WHEN d <= {n.hash_reject} THEN 'grey' END AS route FROM both_{z}) WHERE route IS NOT NULL",
        ),
        f"grey_{z}": (
            f"routes_{z} lib",
            f"SELECT id_lo, id_hi, {_COSINE.format('a', 'c')} AS score, accept, least({C.MODEL_CONFIDENCE}::DOUBLE, {conf}) AS confidence"
            f" FROM routes_{z} JOIN lib a ON a.asset_id = id_lo JOIN lib c ON c.asset_id = id_hi"
            " WHERE route IN ('grey', 'grey_moment') AND len(a.keyframes) = 0 AND len(c.keyframes) = 0 AND a.shape_norm > 0 AND c.shape_norm > 0",
        ),
        f"known_{z}": (
            f"routes_{z} grey_{z}",
            f"SELECT id_lo, id_hi, confidence, route AS via FROM routes_{z} WHERE confidence IS NOT NULL"
            f" UNION ALL SELECT id_lo, id_hi, confidence, 'shape' FROM grey_{z} WHERE score >= accept",
        ),
        f"near_{z}": (
            f"lists known_{z} lib",
            f"SELECT id_lo, id_hi, least({C.MODEL_CONFIDENCE}::DOUBLE, 0.35::DOUBLE * score + 0.65::DOUBLE * s) AS confidence FROM ("
            f"SELECT p.*, {_SIM} AS s FROM (SELECT least(query, point) AS id_lo, greatest(query, point) AS id_hi, max(score) AS score FROM lists"
            f" WHERE score >= {n.neighbour_accept}::DOUBLE GROUP BY ALL) p JOIN lib a ON a.asset_id = p.id_lo JOIN lib c ON c.asset_id = p.id_hi"
            f" WHERE NOT (a.kind = 1 AND c.kind = 1) AND abs(a.mean_luma - c.mean_luma) <= {C.LUMA_TOLERANCE}::DOUBLE AND {_ASPECT.format(C.NEIGHBOUR_ASPECT)}"
            f" AND NOT EXISTS (SELECT 1 FROM known_{z} k WHERE k.id_lo = p.id_lo AND k.id_hi = p.id_hi)) WHERE s >= {n.histogram_accept}::DOUBLE",
        ),
        f"edges_{z}": (f"known_{z} near_{z}", f"SELECT * FROM known_{z} UNION ALL SELECT id_lo, id_hi, confidence, 'neighbour' FROM near_{z}"),
        f"links_{z}": (f"edges_{z}", f"SELECT id_lo AS a, id_hi AS b FROM edges_{z} UNION SELECT id_hi, id_lo FROM edges_{z}"),
        f"comp_{z}": (f"links_{z}", f"RECURSIVE links_{z}"),
        f"sided_{z}": (
            f"edges_{z} comp_{z}",
            f"SELECT root, a, b, max(c) AS c FROM (SELECT id_lo AS a, id_hi AS b, confidence AS c FROM edges_{z}"
            f" UNION ALL SELECT id_hi, id_lo, confidence FROM edges_{z}) JOIN comp_{z} ON node = a GROUP BY ALL",
        ),
        # in each component, a round at a time: the free node with most free neighbours, and the surest of these
        f"greedy_{z}": (
            f"sided_{z} comp_{z}",
            f"AS (root, free, picked) AS (SELECT root, list(node), CAST([] AS BIGINT[]) FROM comp_{z} GROUP BY root UNION ALL"
            " SELECT root, list_filter(free, lambda x: NOT list_contains(picked, x)), picked FROM ("
            f"SELECT s.root, any_value(s.free) AS free, list_prepend(any_value(anchor), list(l.b ORDER BY l.c DESC, l.b)[:{C.MAX_GROUP - 1}]) AS picked FROM ("
            "SELECT root, any_value(free) AS free, arg_max(node, d * 10000000000 - node) AS anchor FROM ("
            f"SELECT g.root, l.a AS node, any_value(g.free) AS free, count(*) AS d FROM greedy_{z} g JOIN sided_{z} l ON l.root = g.root"
            " WHERE list_contains(g.free, l.a) AND list_contains(g.free, l.b) GROUP BY g.root, l.a) GROUP BY root) s"
            f" JOIN sided_{z} l ON l.a = s.anchor AND list_contains(s.free, l.b) GROUP BY s.root))",
        ),
        f"stars_{z}": (
            f"greedy_{z}",
            "SELECT picked[1] AS cluster, unnest(picked) AS node, CAST(generate_subscripts(picked, 1) - 1 AS INTEGER) AS position"
            f" FROM greedy_{z} WHERE len(picked) > 0",
        ),
        f"members_{z}": (
            f"comp_{z} lib",
            f"SELECT root AS group_id, row_number() OVER (PARTITION BY root ORDER BY lib.asset_id) - 1 AS position, lib.* FROM comp_{z} JOIN lib ON lib.asset_id = node",
        ),
    }


_TURN = (
    "[CASE WHEN i < 240 THEN -s[240 + (14 - i % 15) * 16 + i // 15 + 1] ELSE s[(15 - (i - 240) % 16) * 15 + (i - 240) // 16 + 1] END FOR i IN range(480)]"
)
PARTS["points"] = (
    "lib",
    f"SELECT asset_id, CAST(shape AS DOUBLE[]) AS s, shape_norm FROM lib WHERE len(keyframes) = 0 AND shape_norm > 0 AND mean_luma >= {C.DARK} AND mean_luma <= {C.BRIGHT}",
)
PARTS["turn1"] = ("points", f"SELECT asset_id, {_TURN} AS s, shape_norm FROM points")
PARTS["turn2"] = ("turn1", f"SELECT asset_id, {_TURN} AS s, shape_norm FROM turn1")
PARTS["turn3"] = ("turn2", f"SELECT asset_id, {_TURN} AS s, shape_norm FROM turn2")
PARTS["turned"] = (
    "points turn1 turn2 turn3",
    "SELECT *, 0 AS turn FROM points" + "".join(f" UNION ALL SELECT *, {k} FROM turn{k}" for k in (1, 2, 3)),
)
PARTS["scores"] = (
    "turned points",
    "SELECT * FROM (SELECT q.asset_id AS query, p.asset_id AS point, q.turn, list_dot_product(q.s, p.s)"
    " / sqrt(CAST(q.shape_norm AS DOUBLE) * CAST(p.shape_norm AS DOUBLE)) AS score FROM turned q, points p)"
    f" WHERE score >= {C.NEIGHBOUR_FLOOR}::DOUBLE",
)
PARTS["lists"] = (
    "scores",
    "SELECT query, point, max(score) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query, turn ORDER BY score DESC, point) AS n FROM scores)"
    f" WHERE n <= {C.NEIGHBOUR_LIMIT + 1} AND query <> point GROUP BY ALL",
)
PARTS["resources"] = (
    "",
    "SELECT 8 * l_orderkey AS asset_id, CASE WHEN l_returnflag = 'A' THEN 'adjustment' ELSE 'original' END AS type,"
    " CAST(floor(l_extendedprice) AS BIGINT) AS file_size FROM lineitem",
)
PARTS["faces"] = (
    "",
    "SELECT 8 * c_custkey + k AS asset_id, CAST((c_nationkey + k) % 4 AS INTEGER) AS face_count, ((c_custkey + k) % 11) / 10.0::DOUBLE AS open_eye"
    " FROM customer, (SELECT unnest([0, 1, 4]) AS k) WHERE c_custkey % 3 <> 0",
)


def query(select: str, *names: str, level: str | None = None, extra: dict[str, tuple[str, str]] | None = None) -> str:
    """select with the named parts, and those they need, in front.

    The body of a part is its SELECT, RECURSIVE and the name of a table of links (a, b), or AS and all that follows its name.
    """
    parts = PARTS | (level_parts(level) if level else {}) | (extra or {})
    done: list[str] = []

    def need(name: str) -> None:
        if name in done:
            return
        for n in parts[name][0].split():
            need(n)
        done.append(name)

    for n in names:
        need(n)
    said = []
    for n in done:
        body = parts[n][1]
        if body.startswith("RECURSIVE "):
            links = body.split()[1]
            said.append(
                f"{n}(node, root) USING KEY (node) AS (SELECT DISTINCT a, a FROM {links} UNION SELECT l.a, min(c.root) FROM {links} l"
                f" JOIN {n} c ON c.node = l.b JOIN recurring.{n} AS own ON own.node = l.a WHERE c.root < own.root GROUP BY l.a)"
            )
        elif body.startswith("AS "):
            said.append(n + body[3:])
        else:
            said.append(f"{n} AS MATERIALIZED ({body})")
    return f"WITH RECURSIVE {', '.join(said)} {select}"
