import hashlib
import json
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from conftest import audit_rows
from spacelens.config import ScoreConfig, SensitivityConfig, WhitespaceConfig
from spacelens.operators.derive import derive
from spacelens.plans import views, warehouse
from spacelens.plans.market import Market
from spacelens.sources import facts as fs
from spacelens.sources import stage as stage_module
from spacelens.sources.stage import SHUFFLES_GO, released, stage, stage_root


def test_missing_columns_are_all_named(spark):
    df = spark.createDataFrame([("x",)], "BRANDS string")
    with pytest.raises(fs.SchemaError) as err:
        fs.bind_roles(df, fs.AUDIT_ROLES)
    assert "COMPANY" in str(err.value) and "MAT FEB'26" in str(err.value)


def test_csv_source_with_untidy_cells(spark, tmp_path):
    rows = audit_rows()
    names = list(rows[0])
    rows[0]["MAT FEB'26"] = "n/a"
    rows[1]["COMPANY"] = "  NORDA* "
    lines = [",".join(f'" {n} "' for n in names)]
    lines += [",".join(f'"{r[n]}"' for n in names) for r in rows]
    (tmp_path / "a.csv").write_text("\n".join(lines))
    got = fs.read_facts(spark, str(tmp_path), fmt="csv").orderBy("brand").collect()
    assert len(got) == 7 and len({r["row_id"] for r in got}) == 7
    assert got[0]["value_t2"] == 0.0 and got[1]["company"] == "NORDA*"
    assert got[1]["value_t2"] == 210.0


def test_empty_source_fails(spark, tmp_path):
    names = list(fs.AUDIT_ROLES.values())
    (tmp_path / "a.csv").write_text(",".join(f'"{n}"' for n in names) + "\n")
    with pytest.raises(fs.SchemaError, match="no rows"):
        fs.read_facts(spark, str(tmp_path), fmt="csv")


def test_parquet_source_prunes_columns(spark, tmp_path):
    rows = audit_rows()
    spark.createDataFrame(rows).withColumn("unused", F.lit(1)).write.parquet(str(tmp_path / "p"))
    df = fs.read_facts(spark, str(tmp_path / "p"))
    assert df.count() == 7
    plan = df.groupBy("segment").agg(F.sum("value_t2"))._jdf.queryExecution().executedPlan().toString()
    assert "unused" not in plan and "FINAL NFC" not in plan


def test_the_published_layout_is_checked_in_full(spark, tmp_path):
    df = spark.createDataFrame(audit_rows())
    df.write.parquet(str(tmp_path / "short"))
    with pytest.raises(fs.SchemaError) as err:
        fs.read_audit(spark, str(tmp_path / "short"))
    assert all(c in str(err.value) for c in fs.AUDIT_EXTRA_COLUMNS)
    full = df.withColumns({c: F.lit("10") for c in fs.AUDIT_EXTRA_COLUMNS})
    full.write.parquet(str(tmp_path / "full"))
    assert fs.read_audit(spark, str(tmp_path / "full")).count() == 7
    assert len(fs.AUDIT_REQUIRED) == 30
    assert len(fs.audit_numeric_columns(full)) == 15


def test_coercion(spark):
    df = spark.createDataFrame([("1.5 ", "x"), ("bad", "y"), (None, "z")], "MAT string, t string")
    assert [r["MAT"] for r in fs.coerce_numeric(df, ["MAT"]).collect()] == [1.5, 0.0, 0.0]
    report = fs.coercion_report(df, ["MAT"]).collect()
    assert [(r["column"], r["unparseable"]) for r in report] == [("MAT", 1)]


def test_only_plain_numbers_are_numbers(spark):
    texts = ["1d", "5f", "0x1p3", "NaN", "1_0", "1e", "", "--1", "2e3", "-.5", "+7.", " 3 ", "inf", "-Infinity", None]
    df = spark.createDataFrame([(t, float("nan")) for t in texts], "t string, d double")
    got = [tuple(r) for r in fs.coerce_numeric(df, ["t", "d"]).collect()]
    want = [0.0] * 8 + [2000.0, -0.5, 7.0, 3.0, float("inf"), float("-inf"), 0.0]
    assert got == [(x, 0.0) for x in want]
    report = {r["column"]: r["unparseable"] for r in fs.coercion_report(df, ["t", "d"]).collect()}
    assert report == {"t": 8, "d": 15}


def test_stage_uses_the_folder_the_session_names(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    root = stage_root(spark)
    assert root == named.rstrip("/") if named else "spacelens-stage-" in root
    out = stage(spark.range(5), "numbers")
    assert out.count() == 5
    assert all(f"{root}/numbers-" in f for f in out.inputFiles())


LOOSE = ScoreConfig(min_value=0.0, min_players=1)


def scores(m):
    return sorted(map(tuple, m.scored.select("level", "space_id", "priority_score").collect()))


def test_warehouse_round_trip(spark, packs, seven_packs, tmp_path):
    path = str(tmp_path / "wh")
    (tmp_path / "source.csv").write_bytes(b"abc")
    warehouse.build_warehouse(packs, "ORBIS*", path, source=str(tmp_path / "source.csv"), as_of="2024-03")
    tables = warehouse.read_warehouse(spark, path)
    assert tables["space_facts"].count() == 22 and tables["space_membership"].count() == 44
    meta = {r["key"]: json.loads(r["json"])["value"] for r in tables["build_metadata"].collect()}
    assert meta["sku_rows"] == 7 and meta["membership_rows"] == 44
    assert meta["market_value_latest"] == 905 and meta["focal_share_pct"] == pytest.approx(16.5746)
    one = hashlib.sha256(b"abc").hexdigest()
    assert meta["source_sha256"] == hashlib.sha256(one.encode()).hexdigest()
    assert meta["as_of"] == "2024-03" and meta["built_at"].startswith("20")
    again = warehouse.market_from_warehouse(spark, path, score=LOOSE)
    assert scores(again) == scores(seven_packs)


def test_a_failed_write_leaves_the_last_version(spark, packs, seven_packs, tmp_path):
    path = str(tmp_path / "wh")
    first = warehouse.write_warehouse(seven_packs, derive(packs, "ORBIS*"), path)
    broken = derive(packs, "ORBIS*").withColumn("row_id", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        warehouse.write_warehouse(seven_packs, broken, path)
    assert f"/versions/{first}/" in warehouse.read_warehouse(spark, path)["cells"].inputFiles()[0]
    with pytest.raises(Exception, match="lost"):
        warehouse.build_warehouse(packs.withColumn("brand", F.raise_error(F.lit("lost")).cast("string")), "ORBIS*", path)
    assert warehouse.read_warehouse(spark, path)["sku_facts"].count() == 7


def test_a_warehouse_is_rewritten_from_itself_and_old_versions_expire(spark, packs, seven_packs, tmp_path):
    path = str(tmp_path / "wh")
    warehouse.write_warehouse(seven_packs, derive(packs, "ORBIS*"), path)
    for _ in range(3):
        m = warehouse.market_from_warehouse(spark, path, score=LOOSE)
        last = warehouse.write_warehouse(m, warehouse.read_warehouse(spark, path)["sku_facts"], path, keep=2)
    kept = sorted(p.name for p in (tmp_path / "wh" / "versions").iterdir())
    assert len(kept) == 2 and last in kept
    assert scores(warehouse.market_from_warehouse(spark, path, score=LOOSE)) == scores(seven_packs)


def test_a_table_that_was_lost_is_named(spark, packs, seven_packs, tmp_path):
    path = str(tmp_path / "wh")
    version = warehouse.write_warehouse(seven_packs, derive(packs, "ORBIS*"), path)
    (tmp_path / "wh" / "versions" / version / "brand_facts" / "_SUCCESS").unlink()
    with pytest.raises(warehouse.WarehouseMissing, match="lacks brand_facts"):
        warehouse.read_warehouse(spark, path)


def test_incomplete_warehouse_names_what_is_missing(spark, tmp_path):
    with pytest.raises(warehouse.WarehouseMissing, match="space_facts"):
        warehouse.read_warehouse(spark, str(tmp_path / "nothing"))


def test_a_file_of_many_ranges(spark, tmp_path):
    contents = {"long one.bin": bytes(range(256)) * 40 + b"end", "even 100%25.bin": b"x" * 2000}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "empty.bin").write_bytes(b"")
    rows = warehouse.source_digests(spark, str(tmp_path), range_bytes=1000).collect()
    assert len(rows) == len(contents)
    for r in rows:
        data = next(d for n, d in contents.items() if r["path"].endswith("/" + n))
        parts = [hashlib.sha256(data[i : i + 1000]).hexdigest() for i in range(0, len(data), 1000)]
        want = parts[0] if len(parts) == 1 else hashlib.sha256(",".join(parts).encode()).hexdigest()
        assert (r["bytes"], r["sha256"]) == (len(data), want)


def test_digests(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"abc")
    row = warehouse.source_digests(spark, str(tmp_path)).first()
    assert row["sha256"].startswith("ba7816bf") and row["bytes"] == 3


def test_export(spark, packs, seven_packs, tmp_path):
    path = str(tmp_path / "out")
    warehouse.export(seven_packs, packs, path)
    card = spark.read.option("header", True).csv(path + "/scorecard")
    assert card.count() == 22 and "priority_score" in card.columns
    assert spark.read.json(path + "/totals").first()["market_value_t2"] == 905


def test_views(spark, seven_packs):
    assert views.market_overview(seven_packs).first()["market_value"] == 905.0
    lookups = spark.createDataFrame(
        [("id", "seg_allergy"), ("label", "allergy"), ("part", "ibuprofen"),
         ("none", "zzz")],
        "lookup string, text string",
    )
    got = {r["lookup"]: (r["how"], r["space_id"]) for r in views.find_spaces(seven_packs.scored, lookups).collect()}
    assert got["id"] == (1, "SEG_ALLERGY")
    assert got["label"] == (2, "SEG_ALLERGY")
    # The largest label that holds the word.
    assert got["part"] == (3, "ANC_IBUPROFEN") and "none" not in got
    profile = views.competitor_profile(seven_packs, "nord").first()
    assert (profile["company"], profile["value"]) == ("NORDA", 260.0)
    standing = views.competitive_standing(seven_packs, "ORBIS", top=2).collect()
    assert {(r["company_clean"], r["market_rank"]) for r in standing} == {
        ("NORDA", 1), ("MERIDIAN", 2), ("ORBIS", 4)
    }
    portfolio = views.focal_portfolio(seven_packs).first()
    assert portfolio["sku_count"] == 2 and portfolio["molecule_count"] == 2
    chosen, tensions, missing = views.compare_spaces(
        seven_packs.scored, ["SEG_ALLERGY", "pain rel", "nothing"], "segment"
    )
    assert [r["lookup"] for r in missing.collect()] == ["nothing"]
    # The larger segment also grows faster, so there is no choice between size and growth.
    assert chosen.count() == 2 and tensions.first()["size_growth"] is None
    _, tensions, _ = views.compare_spaces(
        seven_packs.scored, ["sub_pain_relief_plain_pain", "SUB_ALLERGY_DUAL_ALLERGY"], "sub_segment"
    )
    assert tensions.first()["size_growth"].startswith("largest: ")
    with pytest.raises(ValueError):
        views.rank_opportunity_spaces(seven_packs, rank_by="space_id")


def test_names_that_nothing_answers_to(spark, seven_packs, packs):
    assert views.require_company(seven_packs, " nord") == "NORDA"
    for view in (views.competitor_profile, views.competitor_strongholds, views.competitor_brands):
        with pytest.raises(views.NotFound, match="nobody"):
            view(seven_packs, "nobody")
    assert views.rank_opportunity_spaces(seven_packs, "segment", min_value=1e9).count() == 0
    with pytest.raises(views.NotFound, match="level segment"):
        views.rank_opportunity_spaces(seven_packs, "segment", min_value=1e9, strict=True)
    views.require_focal(seven_packs)
    with pytest.raises(views.NotFound, match="focal"):
        views.require_focal(Market.build(packs, "NOBODY*", score=LOOSE))


def test_adhoc_sql_returns_all_rows_of_a_query(spark, seven_packs):
    views.register_views(seven_packs)
    assert views.adhoc_sql(spark, "SELECT * FROM space_facts").count() == 22
    assert views.adhoc_sql(spark, "SELECT * FROM range(500)").count() == 500
    assert views.adhoc_sql(spark, "SELECT * FROM range(500)", limit=7).count() == 7
    assert views.adhoc_sql(spark, "WITH a AS (SELECT 1 x) SELECT * FROM a;").count() == 1
    assert views.adhoc_sql(spark, "SELECT ';' AS c UNION ALL (VALUES ('x'))").count() == 2


@pytest.mark.parametrize(
    "statement",
    [
        "DROP VIEW space_facts",
        "CREATE TEMP VIEW v AS SELECT 1",
        "INSERT INTO t SELECT 1",
        "WITH a AS (SELECT 1 AS id) INSERT INTO t SELECT * FROM a",
        "FROM range(3) INSERT INTO t SELECT id INSERT INTO u SELECT id",
        "SET spark.sql.shuffle.partitions = 1",
        "SELECT 1; SELECT 2",
        "SELECT 1; DROP VIEW space_facts",
        "EXPLAIN SELECT 1",
        "SELECT reflect('java.lang.System', 'getProperty', 'user.dir')",
        "SELECT id FROM range(3) WHERE java_method('java.lang.System', 'nanoTime') > id",
        "SELECT (SELECT max(try_reflect('java.lang.System', 'nanoTime'))) AS x",
        "VALUES (reflect('java.lang.System', 'nanoTime'))",
        "WITH a AS (VALUES (reflect('java.lang.System', 'nanoTime'))) SELECT * FROM a",
        "SELECT * FROM range(length(reflect('java.lang.System', 'nanoTime')))",
        "SELECT IDENTIFIER('ref' || 'lect')('java.lang.System', 'nanoTime')",
        "SELECT * FROM parquet.`/tmp`",
        "SELECT 1 WHERE EXISTS (SELECT * FROM text.`/etc/hostname`)",
        "SELECT own_code(id) FROM range(3)",
        "selec 1",
        "",
    ],
)
def test_adhoc_sql_refuses_what_is_not_one_query(spark, statement):
    spark.udf.register("own_code", lambda x: x, "long")
    with pytest.raises(ValueError):
        views.adhoc_sql(spark, statement)


def test_adhoc_sql_allows_the_usual_shapes_and_says_when_rows_are_left(spark, seven_packs):
    views.register_views(seven_packs)
    query = """WITH big AS (SELECT level, space_id, value_t2, rank() OVER (PARTITION BY level ORDER BY value_t2 DESC) AS r
        FROM space_facts WHERE value_t2 > (SELECT min(value_t2) - 1 FROM space_facts))
        SELECT b.level, upper(s.space_label) AS label, count(*) AS n FROM big b JOIN scored s USING (level, space_id)
        WHERE b.space_id IN (SELECT space_id FROM cells) GROUP BY ALL HAVING count(*) > 0 ORDER BY 1, 2"""
    every = views.adhoc_sql(spark, query).count()
    assert every > 1
    rows, more = views.adhoc_page(spark, query, every - 1)
    assert rows.count() == every - 1 and more
    assert not views.adhoc_page(spark, query, every)[1]


def test_level_views(spark, seven_packs):
    with pytest.raises(ValueError):
        views.rank_opportunity_spaces(seven_packs, level="shelf")
    stable = views.sensitivity_analysis(seven_packs, "sub_segment", SensitivityConfig(iterations=10))
    assert [r["level"] for r in stable.collect()] == ["sub_segment"] * 4
    loose = WhitespaceConfig(min_moi=0.0, penetration_ratio=10.0, min_value=0.0)
    levels = {r["level"] for r in views.whitespace_scan(seven_packs, config=loose).collect()}
    assert levels and levels <= set(views.WHITESPACE_LEVELS)


def test_signal_search(spark):
    signals = spark.createDataFrame(
        [("S-01", "Lipids", "Ezetimibe is an add-on to a statin.", "Pub", "https://a"),
         ("S-02", "Prices", "The ceiling price binds.", "Gov", "https://b")],
        "id string, title string, body string, publisher string, url string",
    )
    queries = spark.createDataFrame([(1, "ezetimib add-on")], "query_id int, text string")
    rows = views.search_signals(views.signal_index(signals), signals, queries).orderBy("rank").collect()
    assert rows[0]["citation"] == "[S-01]" and rows[0]["publisher"] == "Pub"
    assert rows[0]["excerpt"].startswith("Lipids")


def test_a_staged_table_gives_its_shuffle_files_back(spark):
    before = spark.conf.get(SHUFFLES_GO, "false")
    with pytest.raises(ValueError):
        with released(spark):
            assert spark.conf.get(SHUFFLES_GO) == "true"
            raise ValueError
    assert spark.conf.get(SHUFFLES_GO) == before
    sums = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("n"))
    one, again = stage(sums, "sums"), stage(sums, "sums")
    assert sorted(one.collect()) == sorted(again.collect()) == sorted(sums.collect())


def test_blocks_give_their_shuffle_back(spark, monkeypatch):
    """The shuffle that deals rows into blocks is held no longer than the table's writing takes."""
    inside = []
    plain = stage_module.released

    @contextmanager
    def seen(session):
        with plain(session):
            inside.append(session.conf.get(SHUFFLES_GO))
            yield

    monkeypatch.setattr(stage_module, "released", seen)
    before = spark.conf.get(SHUFFLES_GO, "false")
    rows = spark.range(100).withColumnRenamed("id", "k").repartition(4, "k")
    assert stage_module.stage_by(rows, "blocks", ["k"], 4).count() == 100
    assert inside == ["true"] and spark.conf.get(SHUFFLES_GO, "false") == before
