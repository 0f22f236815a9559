"""SQL for the queries of the training engine, for an independent engine over the same tables."""

from __future__ import annotations

#: Round as the queries do.
_R = "round({}, {}) + 0.0"


def _r(x: str, digits: int = 6) -> str:
    return _R.format(x, digits)


_X = """x AS (SELECT vec_id, label, i - 1 AS i, CAST(embedding[i] AS DOUBLE) AS v
    FROM (SELECT vec_id, label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"""
_J = "js AS (SELECT j FROM range(10) t(j))"
_W = "((i * 7 + j * 3) % 11 - 5) / 50.0::DOUBLE"
_Z = f"{_X}, {_J}, z AS (SELECT vec_id, label, j, sum(v * {_W}) AS z FROM x, js GROUP BY vec_id, label, j)"
_P = f"{_Z}, e AS (SELECT *, exp(z - max(z) OVER (PARTITION BY vec_id)) AS e FROM z), p AS (SELECT vec_id, label, j, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM e)"
_PIX = f"{_X}, pix AS (SELECT vec_id, i // 8 AS r, i % 8 AS q, v FROM x), k3 AS (SELECT kh, kw FROM range(3) a(kh), range(3) b(kw)), fs AS (SELECT f FROM range(3) t(f))"
_K = "((f * 5 + kh * 3 + kw) % 7 - 3) / 10.0::DOUBLE"


def _conv(stride: int, padding: int, out: int) -> str:
    """Scatter of every pixel to the outputs that see it."""
    return f"""cover AS (SELECT vec_id, kh, kw, (r + {padding} - kh) // {stride} AS oy, (q + {padding} - kw) // {stride} AS ox, v
        FROM pix, k3 WHERE r + {padding} - kh >= 0 AND q + {padding} - kw >= 0 AND (r + {padding} - kh) % {stride} = 0 AND (q + {padding} - kw) % {stride} = 0),
    conv AS (SELECT vec_id, f, oy, ox, sum(v * {_K}) + f / 10.0::DOUBLE AS z FROM cover, fs WHERE oy < {out} AND ox < {out} GROUP BY vec_id, f, oy, ox)"""


_POOL = f"{_PIX}, best AS (SELECT vec_id, r // 2 AS oy, q // 2 AS ox, max(v) AS m FROM pix GROUP BY vec_id, r // 2, q // 2), pool AS (SELECT b.vec_id, oy, ox, any_value(m) AS m, max((r % 2) * 2 + q % 2) AS place FROM best b JOIN pix p ON p.vec_id = b.vec_id AND p.r // 2 = oy AND p.q // 2 = ox AND p.v = m GROUP BY b.vec_id, oy, ox)"
_PART = "part AS (SELECT vec_id AS row_id, CAST(ntile(7) OVER (ORDER BY vec_id) - 1 AS BIGINT) AS worker FROM embeddings)"
_TRACE = "t AS (SELECT user_id % 5 AS worker, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS epoch, avg(value) AS loss FROM events GROUP BY 1, 2)"
_HOUR = "h AS (SELECT event_type AS run, event_id // 200 AS epoch, avg(value) AS loss FROM events GROUP BY 1, 2)"
_QUIET = f"""{_HOUR}, d AS (SELECT *, abs(loss - lag(loss) OVER (PARTITION BY run ORDER BY epoch)) AS d FROM h),
    k AS (SELECT *, sum(CASE WHEN d > 5.0 THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY epoch) AS island FROM d),
    c AS (SELECT run, epoch, row_number() OVER (PARTITION BY run, island ORDER BY epoch) AS quiet FROM k)"""
_PING = """pg AS (SELECT least(l_suppkey % 6, l_partkey % 6) AS src, greatest(l_suppkey % 6, l_partkey % 6) AS dst, l_extendedprice / 99991.0::DOUBLE + l_tax AS rtt
    FROM lineitem WHERE l_suppkey % 6 <> l_partkey % 6)"""
_RUN = """r AS (SELECT 's|' || (o_custkey % 50) AS run_key, o_orderkey AS id, o_totalprice / 99991.0::DOUBLE AS final_loss,
    CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice / 7.0::DOUBLE END AS train_seconds, o_orderkey % 13 = 0 AS switched, o_orderkey % 11 = 0 OR o_custkey % 50 = 7 AS failed, o_totalprice / 13.0::DOUBLE AS l0 FROM orders)"""
_PAR = "o AS (SELECT o_orderkey AS dim, o_totalprice / 99991.0::DOUBLE AS p, o_custkey / 7.0::DOUBLE AS g FROM orders)"
_GRAD = """g AS (SELECT event_id AS pos, value - 50.0::DOUBLE AS value FROM events),
    n AS (SELECT count(*) AS n FROM g), s AS (SELECT abs(value) AS a, row_number() OVER (ORDER BY abs(value)) AS k FROM g),
    th AS (SELECT greatest(a, 0.00006103515625::DOUBLE) AS threshold FROM s, n WHERE k = CAST(floor(n * (1 - 0.3::DOUBLE)) AS BIGINT) + 1)"""

_ACT = "SELECT vec_id, i, v, 2.0::DOUBLE / (1.0::DOUBLE + exp(-v)) AS s, 1.5::DOUBLE * tanh(v) AS t FROM x"
_STEP3 = 0.03 * (1 - 0.999**3) ** 0.5 / (1 - 0.9**3)
_V2 = "0.9::DOUBLE * (p / 3.0::DOUBLE) + (1 - 0.9::DOUBLE) * g"
_S2 = "0.999::DOUBLE * (p * p) + (1 - 0.999::DOUBLE) * g * g"
_SIZES = ((0, 1, 156), (1, 1, 0), (2, 1, 2416), (3, 1, 0), (4, 0, 48120), (5, 1, 10164), (6, 1, 850))



def _half(x: str) -> str:
    """Rounded to half precision: 11 bits, or whole multiples of the smallest subnormal."""
    unit = f"pow(2.0::DOUBLE, greatest(floor(log2(abs({x}))), -14) - 10)"
    return f"CASE WHEN {x} = 0 THEN 0.0::DOUBLE ELSE round_even({x} / {unit}, 0) * {unit} END"


def _training(workers: int, rounds: int, epochs: int, lr: float, update: str, state: str = "0.0::DOUBLE AS v, 0.0::DOUBLE AS s", combine: str = "avg(g)") -> str:
    """Tables l{round}_{epoch} (worker, loss) and p{round} (i, j, w, ..) of softmax regression; i = 64 is the bias.

    Every local epoch is one step of all rows of a worker; gradients are summed over a round's epochs, rounded to
    half precision and combined.
    """
    ctes = [
        f"part AS MATERIALIZED (SELECT vec_id AS row, label, ntile({workers}) OVER (ORDER BY vec_id) - 1 AS worker, embedding FROM embeddings)",
        """xa AS MATERIALIZED (SELECT row, worker, i - 1 AS i, CAST(embedding[i] AS DOUBLE) AS x FROM (SELECT row, worker, embedding, unnest(range(1, 65)) AS i FROM part)
            UNION ALL SELECT row, worker, 64, 1.0::DOUBLE FROM part)""",
        "sizes AS MATERIALIZED (SELECT worker, count(*) AS n FROM part GROUP BY worker)",
        f"p0 AS MATERIALIZED (SELECT i, j, CASE WHEN i < 64 THEN {_W} ELSE j / 7.0::DOUBLE END AS w, {state} FROM range(65) a(i), range(10) b(j))",
    ]
    for r in range(rounds):
        ctes.append(f"w{r}_0 AS MATERIALIZED (SELECT worker, i, j, w FROM p{r}, sizes)")
        for e in range(epochs):
            at = f"{r}_{e}"
            ctes += [
                f"z{at} AS MATERIALIZED (SELECT row, worker, j, sum(x * w) AS z FROM xa JOIN w{at} USING (worker, i) GROUP BY row, worker, j)",
                f"e{at} AS MATERIALIZED (SELECT row, worker, j, exp(z - max(z) OVER (PARTITION BY row)) AS e FROM z{at})",
                f"q{at} AS MATERIALIZED (SELECT row, q.worker, j, j = label AS hit, e / sum(e) OVER (PARTITION BY row) AS q FROM e{at} q JOIN part USING (row))",
                f"l{at} AS MATERIALIZED (SELECT worker, sum(CASE WHEN hit THEN -ln(greatest(q, 1.1920928955078125e-07)) ELSE 0 END) / (10 * any_value(n)) AS loss FROM q{at} JOIN sizes USING (worker) GROUP BY worker)",
                f"""g{at} AS MATERIALIZED (SELECT worker, i, j, sum(x * (q - CASE WHEN hit THEN 1 ELSE 0 END)) / (10 * any_value(n)) AS g
                    FROM q{at} JOIN xa USING (row, worker) JOIN sizes USING (worker) GROUP BY worker, i, j)""",
                f"w{r}_{e + 1} AS MATERIALIZED (SELECT worker, i, j, w - {lr!r}::DOUBLE * g AS w FROM w{at} JOIN g{at} USING (worker, i, j))",
            ]
        union = " UNION ALL ".join(f"SELECT * FROM g{r}_{e}" for e in range(epochs))
        ctes += [
            f"s{r} AS MATERIALIZED (SELECT worker, i, j, sum(g) AS g FROM ({union}) GROUP BY worker, i, j)",
            f"m{r} AS MATERIALIZED (SELECT i, j, {combine} AS g FROM (SELECT i, j, {_half('g')} AS g FROM s{r}) GROUP BY i, j)",
            f"p{r + 1} AS MATERIALIZED (SELECT i, j, {update.format(t=r + 1)} FROM p{r} JOIN m{r} USING (i, j))",
        ]
    return "WITH " + ", ".join(ctes)


def _reported(rounds: int, epochs: int) -> str:
    own = [f"SELECT worker, CAST({r * epochs + e} AS BIGINT) AS epoch, loss FROM l{r}_{e}" for r in range(rounds) for e in range(epochs)]
    return " UNION ALL ".join(own)


def _values(table: str) -> str:
    return f"SELECT CASE WHEN i < 64 THEN 'weight' ELSE 'bias' END AS name, CASE WHEN i < 64 THEN i * 10 + j ELSE j END AS at, {_r('w', 3)} AS value FROM {table}"


_GD = "w - {lr}::DOUBLE * g AS w, v, s"
_TWO = _training(4, 2, 2, 2.0, _GD.replace("{lr}", "2.0"))
_ADAM = """w - 0.05::DOUBLE * sqrt(1 - pow(0.999::DOUBLE, {t})) / (1 - pow(0.9::DOUBLE, {t})) * (0.9::DOUBLE * v + 0.1::DOUBLE * g)
    / (sqrt(0.999::DOUBLE * s + 0.001::DOUBLE * g * g) + 1e-8::DOUBLE) AS w, 0.9::DOUBLE * v + 0.1::DOUBLE * g AS v, 0.999::DOUBLE * s + 0.001::DOUBLE * g * g AS s"""

ORACLE = {
    "allreduce_rounds": f"{_TWO} SELECT worker, epoch, {_r('loss', 5)} AS loss FROM ({_reported(2, 2)})",
    "allreduce_weights": f"{_TWO} {_values('p2')}",
    "adam_weights": f"{_training(4, 2, 1, 0.05, _ADAM)} {_values('p2')}",
    "server_rounds": f"""{_training(3, 3, 1, 2.0, 'w - 2.0::DOUBLE * (0.5::DOUBLE * v + g) AS w, 0.5::DOUBLE * v + g AS v, s')}
        SELECT worker, epoch, {_r('loss', 5)} AS loss FROM ({_reported(3, 1)})""",
    "wild_rounds": f"{_training(3, 2, 1, 1.0, _GD.replace('{lr}', '1.0'), combine='sum(g)')} SELECT worker, epoch, {_r('loss', 5)} AS loss FROM ({_reported(2, 1)})",
    "early_stop": f"""{_training(3, 3, 1, 0.5, _GD.replace('{lr}', '0.5'))} SELECT 'loss' AS kind, worker, epoch, {_r('loss', 5)} AS loss, NULL AS detail FROM ({_reported(3, 1)})
        UNION ALL SELECT 'stop', NULL, NULL, NULL, 'early_stopping'""",
    "predictions": f"""{_TWO}, z AS (SELECT row, j, sum(x * w) AS z FROM xa JOIN p2 USING (i) GROUP BY row, j) SELECT row AS row_id, arg_max(j, z) AS prediction FROM z GROUP BY row""",
    "partition_sizes": f"WITH {_PART} SELECT worker, count(*) AS n, min(row_id) AS first, max(row_id) AS last FROM part GROUP BY worker",
    "batch_index": f"WITH {_PART} SELECT row_id, worker, (row_number() OVER (PARTITION BY worker ORDER BY row_id) - 1) // 64 AS batch FROM part",
    "redistribution": f"""WITH {_PART}, s AS (SELECT row_id, worker, ntile(5) OVER (PARTITION BY worker ORDER BY row_id) - 1 AS share FROM part)
        SELECT CAST(CASE worker WHEN 0 THEN share WHEN 3 THEN share WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 4 THEN 2 WHEN 5 THEN 3 ELSE 4 END AS BIGINT) AS worker,
            count(*) AS n, CAST(sum(row_id) AS BIGINT) AS ids FROM s GROUP BY 1""",
    "vector_chunks": "SELECT ntile - 1 AS chunk, min(dim) AS first, count(*) AS n FROM (SELECT dim, ntile(7) OVER (ORDER BY dim) AS ntile FROM range(640) t(dim)) GROUP BY 1",
    "shuffled_order": f"WITH {_PART} SELECT row_id, worker, row_number() OVER (PARTITION BY worker ORDER BY md5('42:1:' || row_id), row_id) - 1 AS position FROM part",
    "one_hot_labels": "SELECT vec_id AS row_id, k, CASE WHEN k = label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM embeddings, range(10) t(k)",
    "append_rows": """SELECT vec_id AS row_id, round(CAST(embedding[1] AS DOUBLE), 6) AS x0 FROM embeddings
        UNION ALL SELECT vec_id + (SELECT max(vec_id) + 1 FROM embeddings), round(CAST(embedding[1] AS DOUBLE), 6) FROM embeddings WHERE vec_id < 100""",
    "subset_rows": "SELECT vec_id AS row_id, len(embedding) AS width FROM embeddings WHERE vec_id < 100",
    "row_slice": f"WITH {_X} SELECT vec_id AS row_id, {_r('sum(v)')} AS s FROM x WHERE vec_id >= 100 AND vec_id < 150 AND i BETWEEN 8 AND 15 GROUP BY vec_id",
    "dense_forward": f"WITH {_Z} SELECT vec_id, j, {_r('z')} AS z FROM z",
    "dense_join": f"WITH {_Z} SELECT vec_id, j, {_r('z + j / 7.0::DOUBLE')} AS z FROM z",
    "dense_backward": f"""WITH {_P}, ii AS (SELECT i FROM range(64) t(i))
        SELECT vec_id, i, {_r(f'sum((p - CASE WHEN j = label THEN 1 ELSE 0 END) * {_W})')} AS dx FROM p, ii GROUP BY vec_id, i""",
    "softmax": f"WITH {_P} SELECT vec_id, j, {_r('p')} AS p FROM p",
    "softmax_backward": f"WITH {_P} SELECT vec_id, j, {_r('p * ((j + 1) / 7.0::DOUBLE - sum(p * (j + 1) / 7.0::DOUBLE) OVER (PARTITION BY vec_id))')} AS d FROM p",
    "softmax_grad": f"WITH {_P} SELECT i, j, {_r('sum(v * (p - CASE WHEN j = p.label THEN 1 ELSE 0 END))', 4)} AS g FROM p JOIN x USING (vec_id) GROUP BY i, j",
    "conv2d_pad1": f"WITH {_PIX}, {_conv(1, 1, 8)} SELECT vec_id, f, oy, ox, {_r('z')} AS z FROM conv",
    "conv2d_join": f"WITH {_PIX}, {_conv(2, 1, 4)} SELECT vec_id, f, oy, ox, {_r('z')} AS z FROM conv",
    "max_pool_padded": f"""WITH {_PIX}, edge AS (SELECT vec_id, r, q, v FROM pix UNION ALL SELECT vec_id, a.i - 1, b.i - 1, 0.0::DOUBLE FROM embeddings, range(10) a(i), range(10) b(i) WHERE a.i IN (0, 9) OR b.i IN (0, 9))
        SELECT vec_id, oy, ox, {_r('max(v)')} AS m FROM edge, (SELECT oy, ox FROM range(4) a(oy), range(4) b(ox)) o WHERE r BETWEEN 2 * oy - 1 AND 2 * oy + 1 AND q BETWEEN 2 * ox - 1 AND 2 * ox + 1
        GROUP BY vec_id, oy, ox""",
    "conv2d_gradient": f"""WITH {_PIX}, {_conv(2, 1, 4)} SELECT f, kh, kw, {_r('sum(v * z)', 4)} AS g
        FROM cover JOIN conv USING (vec_id, oy, ox) GROUP BY f, kh, kw""",
    "conv2d_input_delta": f"""WITH {_PIX}, {_conv(1, 1, 8)}, d AS (SELECT vec_id, oy + kh - 1 AS r, ox + kw - 1 AS q, sum(z * {_K}) AS d FROM conv, k3 GROUP BY 1, 2, 3)
        SELECT vec_id, r, q, {_r('d')} AS d FROM d WHERE r BETWEEN 0 AND 7 AND q BETWEEN 0 AND 7""",
    "max_pool": f"WITH {_POOL} SELECT vec_id, oy, ox, {_r('m')} AS m, place FROM pool",
    "max_pool_backward": f"WITH {_POOL} SELECT vec_id, oy * 2 + place // 2 AS r, ox * 2 + place % 2 AS q, {_r('m')} AS d FROM pool",
    "reshape_round_trip": f"WITH {_X} SELECT vec_id, i, {_r('v')} AS v FROM x",
    "activations": f"""WITH {_X}, a AS ({_ACT}) SELECT vec_id, i, {_r('s')} AS sig, {_r('t')} AS tnh, {_r('greatest(v, 0.1::DOUBLE * v)')} AS lrelu,
        {_r('s * (1 - s / 2.0::DOUBLE)')} AS dsig, {_r('1.5::DOUBLE - t * t / 1.5::DOUBLE')} AS dtnh, {_r('CASE WHEN v > 0 THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END')} AS dlrelu FROM a""",
    "cross_entropy": f"WITH {_P} SELECT {_r('sum(CASE WHEN j = label THEN -ln(greatest(p, 1.1920928955078125e-07)) ELSE 0 END) / count(*)')} AS loss, count(*) AS n FROM p",
    "linreg_gradient": f"""WITH d AS (SELECT 0.01::DOUBLE * l_quantity - l_extendedprice / 99991.0::DOUBLE AS d, l_quantity AS q FROM lineitem)
        SELECT {_r('avg(d * d)')} AS loss, {_r('avg(2 * d * q)', 4)} AS g_w, {_r('avg(2 * d)')} AS g_b FROM d""",
    "argmax_accuracy": f"""WITH {_P}, m AS (SELECT vec_id, any_value(label) AS label, max(p) AS m FROM p GROUP BY vec_id),
        k AS (SELECT vec_id, any_value(m.label) AS label, max(j) AS l, min(j) AS f FROM m JOIN p USING (vec_id) WHERE p = m GROUP BY vec_id)
        SELECT {_r('avg(CASE WHEN l = label THEN 1.0::DOUBLE ELSE 0 END)')} AS acc_last, {_r('avg(CASE WHEN f = label THEN 1.0::DOUBLE ELSE 0 END)')} AS acc_first, count(*) AS n FROM k""",
    "loss_by_epoch": f"""WITH {_TRACE}, g AS (SELECT epoch, count(*) AS n, max(loss) AS m, avg(loss) AS a FROM t GROUP BY epoch)
        SELECT epoch, n, CASE WHEN n = 5 THEN {_r('m')} END AS max_loss, CASE WHEN n = 5 THEN {_r('a')} END AS mean_loss, {_r('a')} AS mean_of_reported FROM g""",
    "mean_without_promoted": f"WITH {_TRACE} SELECT epoch, {_r('avg(loss)')} AS loss FROM t WHERE worker NOT IN (1, 3) GROUP BY epoch",
    "convergence_epoch": f"WITH {_QUIET} SELECT run, min(epoch) AS epoch FROM c WHERE quiet >= 3 GROUP BY run",
    "quiet_counts": f"WITH {_QUIET} SELECT run, epoch, quiet FROM c",
    "switch_epoch": f"""WITH {_HOUR}, d AS (SELECT *, abs(loss - lag(loss) OVER w) / lag(loss) OVER w AS rel, row_number() OVER w AS n FROM h WINDOW w AS (PARTITION BY run ORDER BY epoch)),
        m AS (SELECT *, avg(rel) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS m FROM d)
        SELECT run, min(epoch) AS epoch FROM m WHERE n >= 6 AND m <= 0.2 GROUP BY run""",
    "loss_admission": "SELECT count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events WHERE event_id % 7 > 2 AND (event_id % 7 = 3 OR value = 0 OR abs(value) >= 2.2250738585072014e-308)",
    "loss_format": """WITH v AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN value / 99991000.0::DOUBLE WHEN event_id % 3 = 1 THEN -value / 7.0::DOUBLE ELSE value END AS x FROM events)
        SELECT event_id, CASE WHEN abs(x) < 1e-4 THEN printf('%.3e', x) ELSE printf('%.8f', x) END AS shown FROM v""",
    "worker_state": f"""SELECT user_id % 8 AS worker, count(*) FILTER (event_id % 97 <> 0) AS epochs_done, {_r('arg_max(value, event_id) FILTER (event_id % 97 <> 0)')} AS last_loss,
        bool_or(event_id % 97 = 0) AS became_server FROM events GROUP BY 1""",
    "event_union": """SELECT event_id AS seq, CASE event_id % 3 WHEN 0 THEN 'loss' WHEN 1 THEN 'stop' ELSE 'push' END AS kind, CASE event_id % 3 WHEN 0 THEN value END AS loss,
        CASE event_id % 3 WHEN 2 THEN user_id END AS worker FROM events""",
    "repeats_agg": f"""WITH {_RUN}, m AS (SELECT run_key, count(*) AS repeats, bool_or(switched) AS switched, avg(train_seconds) AS t, stddev_pop(train_seconds) AS ts,
            avg(final_loss) AS l, stddev_pop(final_loss) AS ls FROM r WHERE NOT failed GROUP BY run_key),
        near AS (SELECT run_key, arg_min(l0, abs(final_loss - l)) AS l0 FROM r JOIN m USING (run_key) WHERE NOT failed GROUP BY run_key)
        SELECT run_key, repeats, switched, NULL AS error, {_r('l0', 4)} AS first_loss, {_r('t', 4)} AS train_seconds, {_r('ts', 4)} AS train_seconds_std, {_r('l', 4)} AS final_loss, {_r('ls', 4)} AS final_loss_std
        FROM m JOIN near USING (run_key)
        UNION ALL SELECT run_key, NULL, arg_min(switched, id), 'failed ' || min(id), NULL, {_r('arg_min_null(train_seconds, id)', 4)}, NULL, {_r('arg_min(final_loss, id)', 4)}, NULL
        FROM r GROUP BY run_key HAVING bool_and(failed)""",
    "run_metrics": f"""WITH a AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 <> 0 THEN o_custkey / 7.0::DOUBLE END AS secs, o_custkey AS samples,
            CASE WHEN o_orderkey % 6 = 0 THEN 0 ELSE 3 END AS n, o_totalprice AS t, CASE WHEN o_orderkey % 4 <> 0 THEN 0.5::DOUBLE END AS acc FROM orders),
        b AS (SELECT *, CASE WHEN n > 0 THEN t / 7.0::DOUBLE END AS l0, CASE WHEN n > 0 THEN t / 17.0::DOUBLE END AS l1, CASE WHEN secs <> 0 THEN secs END AS s, CASE WHEN samples <> 0 THEN samples END AS m FROM a)
        SELECT id, CAST(n AS BIGINT) AS epochs_ran, {_r('l1')} AS final_loss, {_r('n / s')} AS epochs_per_sec, {_r('m * n / s')} AS samples_per_sec, {_r('(l0 - l1) / s')} AS loss_per_sec, {_r('acc / s')} AS accuracy_per_sec FROM b""",
    "newest_run": f"WITH {_RUN} SELECT run_key, max(id) AS id, {_r('arg_max(final_loss, id)')} AS final_loss FROM r GROUP BY run_key",
    "interval_ema": f"""WITH RECURSIVE s AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events),
        f AS (SELECT user_id, sum(value * 0.3::DOUBLE * pow(0.7::DOUBLE, n - k)) + 60000.0::DOUBLE * pow(0.7::DOUBLE, any_value(n)) AS ema FROM s GROUP BY user_id)
        SELECT user_id AS worker, {_r('ema', 4)} AS ema FROM f""",
    "ping_stats": f"WITH {_PING} SELECT src, dst, {_r('min(rtt)')} AS min_rtt, {_r('max(rtt)')} AS max_rtt, {_r('avg(rtt)')} AS avg_rtt FROM pg GROUP BY src, dst",
    "server_choice": f"""WITH {_PING}, w AS (SELECT src AS a, dst AS b, max(rtt) AS w FROM pg GROUP BY 1, 2), u AS (SELECT a, b, w FROM w UNION ALL SELECT b, a, w FROM w),
        p AS (SELECT x.i AS s1, y.i AS s2 FROM range(6) x(i), range(6) y(i) WHERE x.i < y.i),
        m AS (SELECT s1, s2, max(w) AS worst FROM p JOIN u ON (a = s1 AND b <> s2) OR (a = s2 AND b <> s1) GROUP BY s1, s2)
        SELECT s1, s2, {_r('worst')} AS worst FROM m ORDER BY m.worst, s1, s2 LIMIT 1""",
    "ring_order": f"""WITH {_PING}, w AS (SELECT src AS a, dst AS b, max(rtt) AS w FROM pg GROUP BY 1, 2), u AS (SELECT a, b, w FROM w UNION ALL SELECT b, a, w FROM w),
        s AS (SELECT [0, a.i, b.i, c.i, d.i, e.i] AS ring FROM range(1, 6) a(i), range(1, 6) b(i), range(1, 6) c(i), range(1, 6) d(i), range(1, 6) e(i)
            WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5 AND a.i < e.i),
        h AS (SELECT ring, ring[k + 1] AS x, ring[(k + 1) % 6 + 1] AS y FROM s, range(6) t(k)),
        best AS (SELECT ring FROM h JOIN u ON a = x AND b = y GROUP BY ring ORDER BY sum(w) LIMIT 1)
        SELECT least(x, y) AS a, greatest(x, y) AS b FROM h JOIN best USING (ring)""",
    "node_roles": f"""WITH {_PING}, w AS (SELECT src AS a, dst AS b, max(rtt) AS w FROM pg GROUP BY 1, 2), u AS (SELECT a, b, w FROM w UNION ALL SELECT b, a, w FROM w),
        p AS (SELECT x.i AS s1, y.i AS s2 FROM range(6) x(i), range(6) y(i) WHERE x.i < y.i),
        m AS (SELECT s1, s2, max(w) AS worst FROM p JOIN u ON (a = s1 AND b <> s2) OR (a = s2 AND b <> s1) GROUP BY s1, s2 ORDER BY worst, s1, s2 LIMIT 1),
        left_ AS (SELECT i, row_number() OVER (ORDER BY i) AS k FROM range(6) t(i), m WHERE i <> s1 AND i <> s2),
        rings AS (SELECT [w1.i, a.i, b.i, c.i] AS ring FROM left_ w1, left_ a, left_ b, left_ c WHERE w1.k = 1 AND len(list_distinct([w1.i, a.i, b.i, c.i])) = 4 AND a.i < c.i),
        h AS (SELECT ring, ring[k + 1] AS x, ring[(k + 1) % 4 + 1] AS y FROM rings, range(4) t(k)),
        best AS (SELECT ring FROM h JOIN u ON a = x AND b = y GROUP BY ring ORDER BY sum(w) LIMIT 1)
        SELECT 'ring' AS role, least(x, y) AS node, greatest(x, y) AS next FROM h JOIN best USING (ring)
        UNION ALL SELECT 'server', s1, NULL FROM m UNION ALL SELECT 'server', s2, NULL FROM m""",
    "text_source": f"WITH {_X} SELECT vec_id AS row_id, count(*) AS width, {_r('sum(v)', 4)} AS total, {_r('any_value(CAST(label AS DOUBLE))')} AS y FROM x GROUP BY vec_id",
    "packed_source": f"WITH {_X} SELECT vec_id AS row_id, count(*) AS width, {_r('sum(v)', 4)} AS total, {_r('any_value(CAST(label AS DOUBLE))')} AS y FROM x GROUP BY vec_id",
    "idx_source": f"WITH {_X} SELECT vec_id AS row_id, {_r('CAST(sum(CAST(floor(abs(v) * 1000) AS BIGINT) % 256) AS DOUBLE)', 1)} AS grey, CAST(any_value(label) AS BIGINT) AS label FROM x GROUP BY vec_id",
    "history_source": f"SELECT 's|' || o_orderkey AS run_key, {_r('CASE WHEN o_orderkey % 4 = 0 THEN -1 ELSE 1 END * o_totalprice / 7.0::DOUBLE', 4)} AS final_loss FROM orders",
    "config_source": "SELECT CAST(l AS BIGINT) AS layer, k AS kind, CAST(p AS BIGINT) AS parameters, CAST(i AS BIGINT) AS inputs, CAST(o AS BIGINT) AS outputs FROM (VALUES (0, 'conv', 3 * 9 + 3, 64, 192), (1, 'max_pooling', 0, 192, 48), (2, 'dense', 48 * 20 + 20, 48, 20), (3, 'dense', 20 * 10 + 10, 20, 10)) t(l, k, p, i, o)",
    "first_parameters": """SELECT k AS kind, CAST(n AS BIGINT) AS n, round(CAST(m AS DOUBLE) * 50) / 50 AS mean, round(CAST(d AS DOUBLE) * 50) / 50 AS deviation, true AS bounded FROM (VALUES ('const', 40000, 0.24, 0),
        ('uniform', 40000, 1, 4 / sqrt(12)), ('uniform_inclusive', 40000, 1, 4 / sqrt(12)), ('normal', 40000, 2, 0.5), ('kaiming', 40000, 0, sqrt(2 / 100)), ('xavier', 40000, 0, sqrt(2 / 150)),
        ('lecun', 40000, 0, sqrt(1 / 100)), ('xavier_uniform', 40000, 0, sqrt(6 / 150) / sqrt(3)), ('lecun_uniform', 40000, 0, sqrt(3 / 100) / sqrt(3)), ('inline_params', 3, 7, 0)) t(k, n, m, d)""",
    "half_push": f"SELECT user_id % 64 AS worker, event_id AS pos, {_half('v')} AS arrived, 0.0::DOUBLE AS \"left\" FROM (SELECT user_id, event_id, CAST(CAST(value - 50.0::DOUBLE AS FLOAT) AS DOUBLE) AS v FROM events)",
    "sparse_push": f"""WITH g AS (SELECT user_id % 64 AS worker, event_id AS pos, CAST(CAST(value - 50.0::DOUBLE AS FLOAT) AS DOUBLE) AS v FROM events),
        s AS (SELECT *, row_number() OVER (PARTITION BY worker ORDER BY abs(v)) - 1 AS k, count(*) OVER (PARTITION BY worker) AS n FROM g),
        th AS (SELECT worker, greatest(abs(v), pow(2.0::DOUBLE, -14)) AS least FROM s WHERE k = CAST(floor(n * (1 - 0.3::DOUBLE)) AS BIGINT)),
        kept AS (SELECT worker, pos, v, n, abs(v) >= least AS kept FROM s JOIN th USING (worker)),
        runs AS (SELECT *, kept AND NOT coalesce(lag(kept) OVER (PARTITION BY worker ORDER BY pos), false) AS opens FROM kept),
        form AS (SELECT worker, 8 + 8 * count(*) FILTER (opens) + 2 * count(*) FILTER (kept) <= 2 * any_value(n) AS sparse FROM runs GROUP BY worker)
        SELECT worker, pos, CASE WHEN kept OR NOT sparse THEN {_half('v')} ELSE 0 END AS arrived, CASE WHEN kept OR NOT sparse THEN 0 ELSE v END AS "left" FROM kept JOIN form USING (worker)""",
    "gd_step": f"WITH {_PAR} SELECT dim, {_r('p - 0.03::DOUBLE * g')} AS p2 FROM o",
    "momentum_step": f"WITH {_PAR}, v AS (SELECT *, 0.9::DOUBLE * (p / 3.0::DOUBLE) + g AS v2 FROM o) SELECT dim, {_r('p - 0.03::DOUBLE * v2')} AS p2, {_r('v2')} AS v2 FROM v",
    "adam_step": f"""WITH {_PAR}, v AS (SELECT *, {_V2} AS v2, {_S2} AS s2 FROM o)
        SELECT dim, {_r(f'p - {_STEP3!r}::DOUBLE * v2 / (sqrt(s2) + 1e-8::DOUBLE)')} AS p2, {_r('v2')} AS v2, {_r('s2', 4)} AS s2 FROM v""",
    "mean_gradient": f"SELECT l_partkey % 1000 AS dim, {_r('sum(l_discount / 7.0::DOUBLE) / 4')} AS value FROM lineitem GROUP BY 1",
    "sparse_threshold": f"WITH {_GRAD} SELECT {_r('threshold')} AS threshold FROM th",
    "sparse_runs": f"""WITH {_GRAD}, k AS (SELECT pos, pos - row_number() OVER (ORDER BY pos) AS island FROM g, th WHERE abs(value) >= threshold),
        r AS (SELECT min(pos) AS start, count(*) AS length FROM k GROUP BY island)
        SELECT start, length, start - coalesce(lag(start + length) OVER (ORDER BY start), 0) AS gap FROM r""",
    "layer_placement": "WITH s(layer, server, size) AS (VALUES "
    + ", ".join(map(str, _SIZES))
    + """), e AS (SELECT *, sum(size) OVER (PARTITION BY server ORDER BY layer) AS e FROM s)
        SELECT CAST(layer AS BIGINT) AS layer, CAST(server AS BIGINT) AS server, CAST(e - size AS BIGINT) AS start, CAST(e AS BIGINT) AS "end" FROM e""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
