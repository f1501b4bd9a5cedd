import json

import pytest

from quietlake.operators import profile
from quietlake.operators.audit import AuditLog, log_lines, log_view, verify_chain
from quietlake.operators.broker import Broker, Denied, OverCeiling, QueryFailed
from quietlake.operators.suppress import Refused
from quietlake.plans.policy import Policy, Settings
from quietlake.queries import OUTCOMES, POLICY, TABLES
from quietlake.sources import catalog


@pytest.fixture
def broker(spark, sf_dir, tmp_path):
    catalog.files(spark, sf_dir, TABLES)
    return Broker(spark, POLICY, Settings(max_rows_sensitive=8), audit=AuditLog(tmp_path / "log.jsonl", (tmp_path / "copy.jsonl",)), out=tmp_path / "out")


def test_outcomes(broker, tmp_path):
    got = broker.run("SELECT event_type, count(*) AS n FROM events GROUP BY event_type", purpose="test")
    assert got.suppression.rows == 5 and (tmp_path / "out/result.csv").exists()
    doc = json.loads((tmp_path / "out/verdict.json").read_text())
    assert doc["allowed"] and doc["exit_code"] == 0 and doc["purpose"] == "test"
    with pytest.raises(Denied):
        broker.run("SELECT * FROM customer")
    assert not (tmp_path / "out/result.csv").exists()  # a stale result never stays beside a refusal
    with pytest.raises(OverCeiling):
        broker.run("SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey")
    with pytest.raises(Refused):
        broker.run("SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_suppkey < 4 GROUP BY s_nationkey")
    with pytest.raises(QueryFailed) as e:
        broker.run("SELECT count(*) AS n FROM events WHERE nothing = 'secret value'")
    assert "secret" not in str(e.value)
    assert len(list((tmp_path / "out/history").glob("*.json"))) == 5
    verdicts = [json.loads(x)["verdict"] for x in (tmp_path / "log.jsonl").read_text().splitlines()]
    assert verdicts == ["ALLOW", "DENY", "ROW_CEILING", "SCRUB_FAIL", "ERROR"]


def test_exit_codes(spark, sf_dir):
    catalog.files(spark, sf_dir, TABLES)
    b = Broker(spark, POLICY, Settings())
    for code, sql in OUTCOMES[:4]:
        assert b.exit_code(sql) == code, sql


def test_suppressed_and_redacted(spark):
    rows = [(f"d{i}", j) for i in range(8) for j in range(20)] + [("rare", j) for j in range(4)]
    spark.createDataFrame(rows, "dept_id string, v int").createOrReplaceTempView("visits")
    got = Broker(spark, Policy.of({"amber": ["visits"]}), Settings()).run("SELECT dept_id, count(*) AS total_people FROM visits GROUP BY dept_id")
    assert {tuple(r) for r in got.df.collect()} == {(f"d{i}", "20") for i in range(8)} | {("<11", "<11")}
    spark.createDataFrame([(f"ring 541.555.01{i:02d}", i) for i in range(3)], "label string, v int").createOrReplaceTempView("marts")
    got = Broker(spark, Policy.of({"green": ["marts"]}), Settings()).run("SELECT label FROM marts")
    assert {r[0] for r in got.df.collect()} == {"ring <REDACTED:PHONE_NUMBER>"} and got.cells.alarm


def test_views_types_come_from_the_catalog(spark, sf_dir):
    catalog.files(spark, sf_dir, TABLES)
    b = Broker(spark, POLICY, Settings())
    assert b.check("SELECT count(*) AS n, max(value) AS m FROM events").allowed
    assert not b.check("SELECT count(*) AS n, max(event_type) AS m FROM events").allowed


def test_settings(spark):
    spark.conf.set("quietlake.k", "20")
    assert Settings.of(spark).k == 20
    spark.conf.unset("quietlake.k")
    assert Settings.of(spark) == Settings()


def test_chain(spark, tmp_path):
    log = AuditLog(tmp_path / "a.jsonl", (tmp_path / "b.jsonl",))
    for i in range(5):
        log.append("run", i=i, policy="p1" if i < 4 else "p2")
    assert log.verify(spark) == (True, None) and log.mirrors_agree()
    assert log.last_event("run")["i"] == 4 and log.changed("run", policy="p3") == ["policy"] and log.changed("run", policy="p2") == []
    lines = (tmp_path / "a.jsonl").read_text().splitlines()
    (tmp_path / "a.jsonl").write_text("\n".join([lines[0], lines[1].replace('"i": 1', '"i": 9'), *lines[2:]]) + "\n")
    assert log.verify(spark) == (False, 3)
    (tmp_path / "a.jsonl").write_text("\n".join([*lines[:2], *lines[3:]]) + "\n")
    assert log.verify(spark) == (False, 3)
    (tmp_path / "a.jsonl").write_text("\n".join([*lines[:2], "not json", *lines[3:]]) + "\n")
    assert log.verify(spark) == (False, 3)
    assert log_view(log_lines(spark, str(tmp_path / "b.jsonl")), 2).count() == 2
    assert verify_chain(log_lines(spark, str(tmp_path / "b.jsonl"))).filter("ok").count() == 5


def test_profile_and_index(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 1), (None, 2)], "x string, y int")
    assert {tuple(r) for r in profile.profile(df).collect()} == {("x", 3, 2), ("y", 3, 2)}
    assert profile.profile(df, 1).count() == 1
    df.createOrReplaceTempView("prof_t")
    live = profile.snapshot(spark, ["prof_t"], stats=True)
    assert live["prof_t"]["row_count"] == 3 and live["prof_t"]["columns"]["x"]["distinct_count"] == 2
    manifest = {"nodes": {"model.a": {"resource_type": "model", "name": "prof_t", "alias": "prof_t", "columns": {"X": {"description": "a name", "data_type": "text"}}}, "test.b": {"resource_type": "test", "name": "b"}}}
    both = profile.merged(profile.from_manifest(manifest), live)
    assert both["prof_t"]["columns"]["x"] == {"type": "string", "description": "a name", "distinct_count": 2} and list(both) == ["prof_t"]
    profile.save(both, tmp_path / "i.json")
    assert profile.load(tmp_path / "i.json") == both and profile.load(tmp_path / "none.json") == {}
    assert "prof_t" in profile.render(both) and profile.columns_frame(spark, both).count() == 2


def test_levels_agree(spark):
    names = ["raw.a.b", "c_dev.dev_x__reporting.t", "reporting.a.b", "reporting.dev_a.b", "analytics.x.y", "t", "a.b.c.d", "REPORTING.a.b"]
    p = Policy.default()
    got = {r["relation"]: r["level"] for r in profile.classified(spark.createDataFrame([(n,) for n in names], "relation string"), p).collect()}
    assert got == {n: p.level(n) for n in names}


def test_required_entity_scan(spark, sf_dir, tmp_path):
    catalog.files(spark, sf_dir, TABLES)
    sql, strict = "SELECT n_name FROM nation", Settings(require_entity_scan=True)
    with pytest.raises(Refused):
        Broker(spark, POLICY, strict).run(sql)

    def broken():
        raise OSError("no model")

    with pytest.raises(Refused):
        Broker(spark, POLICY, strict, recogniser=broken).run(sql)
    got = Broker(spark, POLICY, strict, recogniser=lambda: lambda text: ["PLACE"] if "A" in text else [], out=tmp_path / "o").run(sql)
    assert got.cells.entities == ["PLACE"] and got.cells.alarm
    assert json.loads((tmp_path / "o/verdict.json").read_text())["hits"]


def test_changed_controls_are_named(spark, sf_dir, tmp_path):
    catalog.files(spark, sf_dir, TABLES)
    log = AuditLog(tmp_path / "log.jsonl")
    for k, changed in ((11, []), (11, []), (12, ["settings_sha256"])):
        Broker(spark, POLICY, Settings(k=k), audit=log).run("SELECT r_name FROM region")
        assert log.last_event("run")["controls_changed"] == changed


def test_log_in_many_splits(spark, tmp_path):
    """Numbers and lines before follow the file, however it is split."""
    log = AuditLog(tmp_path / "long.jsonl")
    for i in range(60):
        log.append("run", i=i, pad="x" * (i % 7 * 40))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        lines = log_lines(spark, str(tmp_path / "long.jsonl"))
        raw = (tmp_path / "long.jsonl").read_text().splitlines()
        got = {r["line_no"]: (r["raw"], r["before"]) for r in lines.collect()}
        assert got == {i + 1: (x, raw[i - 1] if i else None) for i, x in enumerate(raw)}
        assert log.verify(spark) == (True, None)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def test_manifests_and_catalogs(spark, tmp_path):
    for name in ("p/q", "r"):
        (tmp_path / name / "target").mkdir(parents=True)
        (tmp_path / name / "target/manifest.json").write_text(json.dumps({"sources": {"s": {"resource_type": "source", "name": name[-1], "schema": "m", "columns": {"A": {"description": "an a"}}}}}))
    (tmp_path / "broken/target").mkdir(parents=True)
    (tmp_path / "broken/target/manifest.json").write_text("{")
    index, broken = profile.from_manifests(profile.discover(tmp_path))
    assert set(index) == {"m.q", "m.r"} and len(broken) == 1 and index["m.q"]["columns"]["a"]["description"] == "an a"
    names, skipped = profile.relations_of(spark, ["spark_catalog", "no_such_catalog"])
    assert set(skipped) == {"no_such_catalog"} and isinstance(names, list)
    assert profile.snapshot(spark, ["no.such.relation"]) == {}
