"""The same tables as ``fixtures`` in DuckDB SQL, for the oracles."""

from __future__ import annotations

TPS = 254_016_000_000
MS = 254_016_000
MSB = "254016000::BIGINT"


def fdiv(a: str, b: str) -> str:
    return f"((({a}) - ((({a}) % ({b})) + ({b})) % ({b})) // ({b}))"


def snap(t: str, ft: str) -> str:
    return f"({fdiv(t, ft)} * ({ft}))"


def snap_up(t: str, ft: str) -> str:
    return f"(-({fdiv(f'-({t})', ft)}) * ({ft}))"


def r0(x: str) -> str:
    return f"CAST(round({x}) AS BIGINT)"


FT = "CASE {k} % 5 WHEN 0 THEN 10594584000 WHEN 1 THEN 10584000000 WHEN 2 THEN 10160640000 WHEN 3 THEN 8475667200 ELSE 8467200000 END"

TABLES = {
    "sequences": ([], f"""SELECT o_orderkey % 10 AS project_id, o_orderkey AS sequence_id, 'seq ' || o_orderkey AS name,
        CASE o_orderkey % 5 WHEN 0 THEN 24000 WHEN 1 THEN 24 WHEN 2 THEN 25 WHEN 3 THEN 30000 ELSE 30 END AS rate_num,
        CASE o_orderkey % 5 WHEN 0 THEN 1001 WHEN 3 THEN 1001 ELSE 1 END AS rate_den, {FT.format(k='o_orderkey')} AS ft FROM orders"""),
    "numbered": ([], """SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity,
        l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS rn FROM lineitem"""),
    "placed": (["numbered"], f"""SELECT *, CASE WHEN l_suppkey % 3 = 0 THEN 2 ELSE rn % 2 END AS t, {FT.format(k='l_orderkey')} AS ft,
        CAST(l_quantity AS BIGINT) AS df, CAST(round(l_discount * 100) AS BIGINT) % 7 AS gap FROM numbered"""),
    "clips": (["placed"], """SELECT l_orderkey AS sequence_id, l_orderkey * 4 + t AS track_id, CASE WHEN t = 1 THEN 'video' ELSE 'audio' END AS kind,
        l_orderkey * 10000000 + rn AS clip_id, l_partkey AS item_id, 'clip ' || (l_partkey % 50) AS name, rn, ft,
        CAST((sum(df + gap) OVER (PARTITION BY l_orderkey, t ORDER BY rn) - df) * ft AS BIGINT) AS start, df * ft AS duration,
        (l_suppkey % 20) * ft AS source_in, CASE WHEN l_tax > 0.06 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS speed, l_returnflag = 'R' AS reverse,
        l_linestatus = 'O' AS enabled, CAST(NULL AS BIGINT) AS frame_hold FROM placed"""),
    "spans": (["clips"], 'SELECT *, start + duration AS "end" FROM clips'),
    "halves": (["clips"], f"SELECT *, ((duration // ft) // 2) * ft AS h FROM clips"),
    "through": (["halves"], f"""SELECT * EXCLUDE (h) FROM halves WHERE duration <= 20 * ft
        UNION ALL SELECT * EXCLUDE (h) REPLACE (h AS duration, CASE WHEN reverse THEN source_in + {r0('duration * speed')} - {r0('h * speed')} ELSE source_in END AS source_in) FROM halves WHERE duration > 20 * ft
        UNION ALL SELECT * EXCLUDE (h) REPLACE (start + h AS start, duration - h AS duration, clip_id + 5000000 AS clip_id, CASE WHEN reverse THEN source_in ELSE source_in + {r0('h * speed')} END AS source_in) FROM halves WHERE duration > 20 * ft"""),
    "items": ([], """SELECT p_partkey % 10 AS project_id, p_partkey AS item_id, p_name AS name, p_brand AS label,
        CASE WHEN p_partkey % 10 = 9 THEN 'graphic' ELSE 'media' END AS kind, p_type AS m_type, CAST(p_size AS VARCHAR) AS m_size FROM part"""),
    "media": ([], """SELECT p_partkey AS item_id, '/vol/' || p_brand || '/' || p_type || '/' || p_name || '_' || p_partkey || '.mov' AS path, p_partkey % 13 = 0 AS offline,
        CASE WHEN p_partkey % 4 = 0 THEN '/proxy/' || p_partkey || '.mov' END AS proxy_path, CAST(p_size AS BIGINT) * 40 * 10160640000 AS duration,
        (p_partkey % 5) * 254016000000 AS start_timecode, CAST(p_size AS BIGINT) * 1000000 + p_partkey AS size, p_partkey * 7919 AS fingerprint FROM part"""),
    "files": ([], """SELECT CASE WHEN p_partkey % 3 = 0 THEN '/new' ELSE '/vol' END || '/' || p_brand || '/' || p_type || '/' || p_name || '_' || p_partkey || '.mov' AS path,
        CAST(p_size AS BIGINT) * 1000000 + p_partkey + CASE WHEN p_partkey % 11 = 0 THEN 1 ELSE 0 END AS size, p_partkey * 7919 AS fingerprint FROM part WHERE p_partkey % 7 <> 0
        UNION ALL SELECT '/proxy/' || p_partkey || '.mov', 1000, p_partkey FROM part WHERE p_partkey % 4 = 0 AND p_partkey % 8 <> 0"""),
    "points": ([], "SELECT event_id, user_id, event_type, value, props, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) * 254016 AS t FROM events"),
    "markers": (["points"], "SELECT user_id AS owner_id, event_id AS marker_id, t AS start, CAST(0 AS BIGINT) AS duration, event_type AS name, props AS comment FROM points WHERE event_type = 'click'"),
    "tokens": ([], r"""SELECT conv_id, turn, role, unnest(regexp_split_to_array(text, '\s+')) AS text, generate_subscripts(regexp_split_to_array(text, '\s+'), 1) AS pos FROM conversations"""),
    "timed": (["tokens"], f"""SELECT *, greatest(120, length(text) * 60) * {MSB} AS dur, CASE WHEN regexp_matches(text, '[.!?]$') THEN 900 ELSE 40 END * {MSB} AS gap FROM tokens WHERE text <> ''"""),
    "words": (["timed"], """SELECT conv_id AS sequence_id, conv_id AS item_id, row_number() OVER w - 1 AS idx, text,
        CAST(sum(dur + gap) OVER w - dur - gap AS BIGINT) AS start, CAST(sum(dur + gap) OVER w - gap AS BIGINT) AS "end", role AS speaker FROM timed
        WINDOW w AS (PARTITION BY conv_id ORDER BY turn, pos)"""),
    "doclines": ([], r"""SELECT doc_id, [x for x in string_split(text, chr(10)) if trim(x) <> ''] AS ls FROM documents"""),
    "captions": (["doclines"], f"""SELECT track_id, track_id * 1000000 + pos AS caption_id, pos * CAST(2200 AS BIGINT) * {MSB} AS start, CAST(2000 AS BIGINT) * {MSB} AS duration, trim(text) AS text
        FROM (SELECT doc_id AS track_id, unnest(ls) AS text, generate_subscripts(ls, 1) - 1 AS pos FROM doclines)"""),
    "keyframes": (["points"], """SELECT user_id AS owner_id, t AS time, arg_max(value, event_id) AS value,
        CASE WHEN max(event_id) % 3 = 1 THEN 'hold' WHEN max(event_id) % 6 = 2 THEN 'bezier' ELSE 'linear' END AS interp FROM points GROUP BY user_id, t"""),
    "log": ([], """SELECT user_id AS session_id, epoch_us(ts) AS ts_us, event_id AS seq, CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS level,
        's' || (event_id % 2) AS source, event_type AS message FROM events"""),
    "vectors": ([], "SELECT CAST(label AS BIGINT) AS stream_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS rank, embedding FROM embeddings"),
    "samples": (["vectors"], "SELECT stream_id, 0 AS ch, rank * 64 + generate_subscripts(embedding, 1) - 1 AS n, CAST(unnest(embedding) AS DOUBLE) AS x FROM vectors"),
    "pixels": ([], """SELECT frame_id, x, y, ((frame_id * 31 + x * 7 + y * 13) % 256) / 255.0::DOUBLE AS r, ((frame_id * 31 + x * 7 + y * 13 + 17) % 256) / 255.0::DOUBLE AS g,
        ((frame_id * 31 + x * 7 + y * 13 + 34) % 256) / 255.0::DOUBLE AS b, 1.0::DOUBLE AS a
        FROM (SELECT p_partkey AS frame_id FROM part), (SELECT unnest(range(16)) AS x), (SELECT unnest(range(9)) AS y)"""),
}


def using(names: str, body: str) -> str:
    """``body`` with the CTEs it needs in front; ``body`` may start with its own CTEs after a comma."""
    done: list[str] = []

    def add(n):
        if n in done:
            return
        for dep in TABLES[n][0]:
            add(dep)
        done.append(n)

    for n in names.split():
        add(n)
    ctes = ",\n".join(f"{n} AS ({TABLES[n][1]})" for n in done)
    return f"WITH {ctes}{body if body.startswith(',') else chr(10) + body}"
