"""The same inputs as ``bindings``, as ANSI SQL views over the raw tables (for cross-checking)."""

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def view(name: str, needs: tuple[str, ...], sql: str) -> None:
    VIEWS[name] = (needs, sql)


view("ev", (), """SELECT event_id, epoch_us(ts) AS ts_us, user_id, event_type, value, props,
  CAST(regexp_extract(props,'([0-9]+)',1) AS BIGINT) AS k,
  'cnc-'||user_id AS container_id, 'line'||(user_id%4+1) AS line FROM events""")
view("v_scores", ("ev",), """SELECT event_id, ts_us, container_id, line, least(value/100,1.0::DOUBLE) AS anomaly_score,
  'pdm@'||(k%3) AS model_version, CASE WHEN event_type='error' THEN 'bearing wear' END AS fault_class,
  'seg-'||(k%17+1) AS location,
  CASE WHEN event_type IN ('view','error') THEN 'inference' WHEN event_type='click' THEN 'raw'
       WHEN event_type='purchase' THEN 'features' END AS data_classification,
  CAST(length(props)*10 AS BIGINT) AS bytes FROM ev""")
view("v_labels", ("ev",), """SELECT event_id, ts_us, container_id, line,
  CASE WHEN event_type='signup' THEN 'dismiss' ELSE 'bearing wear' END AS label, 'win-'||k AS feature_window_ref
  FROM ev WHERE event_type IN ('purchase','signup')""")
view("v_tl", ("v_scores", "v_labels"), """SELECT *, coalesce(sum(kind) OVER (PARTITION BY container_id
  ORDER BY ts_us, event_id, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS epoch FROM (
  SELECT event_id, ts_us, container_id, anomaly_score, NULL AS label, 0 AS kind FROM v_scores
  UNION ALL SELECT event_id, ts_us, container_id, NULL, label, 1 FROM v_labels)""")
view("v_alerts", ("v_tl",), """SELECT s.event_id AS alert_id, s.ts_us, s.container_id, s.anomaly_score,
  CASE WHEN l.label IS NULL THEN 'unlabeled' WHEN l.label='dismiss' THEN 'dismissed' ELSE 'labeled' END AS state,
  l.label, l.ts_us AS labeled_at_us
  FROM (SELECT *, row_number() OVER (PARTITION BY container_id, epoch ORDER BY ts_us, event_id) AS rn
        FROM v_tl WHERE kind=0 AND anomaly_score>=0.6) s
  LEFT JOIN (SELECT * FROM v_tl WHERE kind=1) l ON s.container_id=l.container_id AND s.epoch=l.epoch WHERE rn=1""")
view("v_deploys", ("ev",), """SELECT event_id, ts_us, line, 'pdm-anomaly@retrained-'||row_number() OVER (ORDER BY ts_us, event_id)
  AS model_version, 'from console' AS detail FROM ev WHERE event_type='error'""")
view("v_model_events", ("v_labels", "v_deploys"), """SELECT ts_us, event_id, line, 'retrain_queued' AS event_type,
  NULL AS model_version, 'queued from 5 label(s)' AS detail FROM (SELECT *, row_number() OVER (ORDER BY ts_us, event_id) AS n
  FROM v_labels WHERE label<>'dismiss') WHERE n%5=0
  UNION ALL SELECT ts_us, event_id, line, 'deployed', model_version, detail FROM v_deploys""")
view("v_fix", ("ev",), """SELECT event_id, ts_us, line, container_id, ts_us AS t_host_us, value/10 AS x, k/10 AS y
  FROM ev WHERE event_type='click'""")
view("v_imu", ("ev",), """SELECT event_id, 's'||(user_id%8) AS session, (ts_us-1704067200000000)//3600 AS t_us, ts_us, event_type, value, k,
  (k-50)/1000 AS ax, (k*7%100-50)/1000 AS ay, 1+value/1000 AS az, (k*3%100-50)/2 AS gx, (k*11%100-50)/2 AS gy, value-50 AS gz,
  CAST(k*37%100-30 AS DOUBLE) AS mx, CAST(k*53%100-20 AS DOUBLE) AS my FROM ev""")
view("v_iv", ("v_imu",), """SELECT session, event_id AS label_id, t_us AS start_us, t_us+CAST(round(value*10000) AS BIGINT) AS end_us,
  CASE WHEN k%3=0 THEN 'fault' WHEN k%3=1 THEN 'qs_wobbly' ELSE 'qs_smooth' END AS label FROM v_imu WHERE event_type='error'""")
view("v_win", ("v_imu",), """SELECT session, event_id AS win_id, t_us AS center_us, least(value/100,1.0::DOUBLE) AS score,
  row_number() OVER (PARTITION BY session ORDER BY t_us, event_id) AS rn FROM v_imu""")
view("v_frames", ("v_imu",), """SELECT session, event_id AS frame_no, t_us AS host_us, 'cam_f'||event_id||'_'||t_us||'.jpg' AS name,
  k/100 AS dark, value/100 AS net FROM v_imu WHERE event_type='view'""")
view("v_sig", (), "SELECT vec_id, 'u'||label AS unit, embedding AS sig FROM embeddings")
view("v_x", ("v_sig",), """SELECT vec_id, unit, CAST(i AS BIGINT) AS i, CAST(sig[i+1] AS DOUBLE) AS x
  FROM v_sig, range(64) r(i)""")
view("v_clips", (), """SELECT doc_id AS clip, source AS recording, CAST(n_chars AS DOUBLE) AS score, CAST(toxic AS DOUBLE) AS score2,
  quality AS y FROM labels JOIN documents USING (doc_id)""")
view("v_profiles", (), """SELECT p_name AS name, CAST(p_partkey AS VARCHAR) AS network, p_size*100.0::DOUBLE AS total_sram_used,
  p_retailprice/20 AS batch_inference_time, CAST(p_size AS DOUBLE) AS cpu_operators, 100.0::DOUBLE-p_size AS npu_operators,
  CASE WHEN p_size>10 THEN p_size*40960.0::DOUBLE END AS artifact_bytes FROM part""")
view("v_spans", (), """SELECT *, start_us+dur AS end_us, dur/1000 AS duration_ms FROM (
  SELECT o_orderkey AS trace_id, 'o'||o_orderkey AS span_id, NULL AS parent_id, 'dev-'||substr(o_orderpriority,1,1) AS service,
    'publish' AS name, 'CLIENT' AS kind, epoch_us(o_orderdate)+o_orderkey%86400*1000000 AS start_us, CAST(floor(o_totalprice) AS BIGINT) AS dur FROM orders
  UNION ALL SELECT l_orderkey, 'l'||l_orderkey||'-'||l_linenumber, 'o'||l_orderkey, 'svc-'||l_returnflag, 'handle-'||l_linestatus, 'SERVER',
    epoch_us(o_orderdate)+o_orderkey%86400*1000000+CAST(trunc(l_quantity*700000) AS BIGINT), CAST(floor(l_extendedprice*10) AS BIGINT)
    FROM lineitem JOIN orders ON l_orderkey=o_orderkey)""")


def staged_sql(source: str, v_thr: float, dwell: int, release: int) -> str:
    """Severity stages of ``source`` (session, id, rn, v), one row after another: ``WITH`` items up to ``staged`` (session, id, rn, stage, trend)."""
    return f"""sl AS (SELECT session, id, rn, v, CASE WHEN count(*) OVER f < 3 THEN 0 ELSE regr_slope(v, rn) OVER f END AS slope
  FROM ({source}) WINDOW f AS (PARTITION BY session ORDER BY rn ROWS 59 PRECEDING)),
st AS (SELECT session, 0::BIGINT AS rn, 0 AS stage, 0 AS up, 0 AS down FROM sl GROUP BY 1
  UNION ALL SELECT session, rn, CASE
    WHEN target>stage AND (target=1 OR up>={dwell}) THEN CASE WHEN stage>=1 THEN least(target, stage+1) ELSE target END
    WHEN target>stage THEN greatest(stage, 1) WHEN target<stage AND down>={release} THEN target ELSE stage END, up, down
  FROM (SELECT *, CASE WHEN up=0 THEN 0 WHEN up<{dwell} THEN 1 WHEN slope>0.001 AND stage>=2 THEN 3 ELSE 2 END AS target FROM (
    SELECT sl.session, sl.rn, st.stage, sl.slope, CASE WHEN sl.v>={v_thr} THEN least(st.up+1, {dwell}) ELSE 0 END AS up,
      CASE WHEN sl.v>={v_thr} THEN 0 ELSE least(st.down+1, {release}) END AS down FROM st JOIN sl ON sl.session=st.session AND sl.rn=st.rn+1))),
staged AS (SELECT sl.session, sl.id, sl.rn, st.stage, CASE WHEN slope>0.001 THEN 'rising' WHEN slope<-0.001 THEN 'falling' ELSE 'stable' END AS trend
  FROM sl JOIN st ON sl.session=st.session AND sl.rn=st.rn)"""


def with_views(names, body: str) -> str:
    """``WITH`` clause for the named views and whatever they need, then the body."""
    order: list[str] = []

    def add(n):
        for need in VIEWS[n][0]:
            add(need)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in order)
    lead = body.lstrip()
    if lead[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes},\n{lead[15:]}"
    if lead[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{lead[5:]}"
    return f"WITH {ctes}\n{body}"
