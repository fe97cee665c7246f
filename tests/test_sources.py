"""CSV staging scan (C1), loads (C2-C4), row count (C20), export (C15)."""

import os
from decimal import Decimal as D

import pytest

from claimlens.operators.summaries import VIEW_ORDER, view_order
from claimlens.schema import STAGING_COLUMNS
from claimlens.sources import loaders, sinks, staging

HEADER = ",".join(STAGING_COLUMNS)


def _line(**over):
    """A valid 28-field staging line; fields given by column name override."""
    base = {c: "" for c in STAGING_COLUMNS}
    base.update({
        "Rndrng_NPI": "1000000001", "Rndrng_Prvdr_Last_Org_Name": "SMITH", "Rndrng_Prvdr_First_Name": "ANN",
        "Rndrng_Prvdr_MI": "Q", "Rndrng_Prvdr_Crdntls": "MD", "Rndrng_Prvdr_Ent_Cd": "I",
        "Rndrng_Prvdr_St1": "1 MAIN ST", "Rndrng_Prvdr_City": "CHICAGO", "Rndrng_Prvdr_State_Abrvtn": "IL",
        "Rndrng_Prvdr_State_FIPS": "17", "Rndrng_Prvdr_Zip5": "60601", "Rndrng_Prvdr_RUCA": "1.0",
        "Rndrng_Prvdr_RUCA_Desc": "Metro", "Rndrng_Prvdr_Cntry": "US", "Rndrng_Prvdr_Type": "Cardiology",
        "Rndrng_Prvdr_Mdcr_Prtcptg_Ind": "Y", "HCPCS_Cd": "99213", "HCPCS_Desc": "Office visit",
        "HCPCS_Drug_Ind": "N", "Place_Of_Srvc": "O", "Tot_Benes": "12", "Tot_Srvcs": "20",
        "Tot_Bene_Day_Srvcs": "20", "Avg_Sbmtd_Chrg": "150.00", "Avg_Mdcr_Alowd_Amt": "90.00",
        "Avg_Mdcr_Pymt_Amt": "70.00", "Avg_Mdcr_Stdzd_Amt": "72.00",
    })
    base.update(over)
    return base


def _csv_field(v):
    if v is None:
        return ""
    if v == "" or any(ch in v for ch in ',"\n') or v != v.strip():
        return '"' + v.replace('"', '""') + '"'
    return v


def _write(path, rows, raw_lines=()):
    with open(path, "w", encoding="utf-8") as fh:
        fh.write(HEADER + "\n")
        for r in rows:
            fh.write(",".join(_csv_field(r[c]) for c in STAGING_COLUMNS) + "\n")
        for raw in raw_lines:
            fh.write(raw + "\n")


def test_csv_dialect(spark, scratch):
    p = os.path.join(scratch, "x.csv")
    rows = [
        _line(Rndrng_Prvdr_St2=None, Rndrng_Prvdr_MI=""),                       # unquoted empty / quoted empty
        _line(Rndrng_NPI="1000000002", Rndrng_Prvdr_Last_Org_Name='O"BRIEN, LLC'),  # doubled quote + comma
        _line(Rndrng_NPI="1000000003", HCPCS_Desc="line one\nline two"),        # newline in quotes
        _line(Rndrng_NPI="1000000004", Rndrng_Prvdr_City="  PADDED  "),         # spaces kept
    ]
    _write(p, rows)
    got = {r["Rndrng_NPI"]: r for r in staging.read_staging(spark, p).collect()}
    assert len(got) == 4
    assert got["1000000001"]["Rndrng_Prvdr_St2"] is None
    assert got["1000000001"]["Rndrng_Prvdr_MI"] == ""
    assert got["1000000002"]["Rndrng_Prvdr_Last_Org_Name"] == 'O"BRIEN, LLC'
    assert got["1000000003"]["HCPCS_Desc"] == "line one\nline two"
    assert got["1000000004"]["Rndrng_Prvdr_City"] == "  PADDED  "


@pytest.mark.parametrize("n_fields", [27, 29])
def test_csv_wrong_field_count_aborts(spark, scratch, n_fields):
    p = os.path.join(scratch, "bad.csv")
    good = _line()
    fields = [_csv_field(good[c]) for c in STAGING_COLUMNS]
    fields = fields[:n_fields] if n_fields < 28 else fields + ["extra"]
    _write(p, [good], raw_lines=[",".join(fields)])
    with pytest.raises(Exception):
        staging.read_staging(spark, p).collect()


def test_staging_row_count(spark, scratch):
    p = os.path.join(scratch, "c.csv")
    _write(p, [_line(Rndrng_NPI=str(1000000000 + i)) for i in range(7)])
    assert staging.staging_row_count(staging.read_staging(spark, p)).collect()[0][0] == 7


def _stg(spark, rows):
    return spark.createDataFrame([tuple(r[c] for c in STAGING_COLUMNS) for r in rows],
                                 staging.STAGING_SCHEMA)


def test_blanks_become_null(spark):
    stg = _stg(spark, [_line(Rndrng_Prvdr_MI="", Rndrng_Prvdr_Crdntls="", Rndrng_Prvdr_St2="",
                             Rndrng_Prvdr_RUCA="", Tot_Benes="", Tot_Srvcs="", Avg_Mdcr_Pymt_Amt="")])
    p = loaders.load_providers(stg).collect()[0]
    assert (p.middle_initial, p.credentials, p.street_2, p.ruca_code) == (None, None, None, None)
    u = loaders.load_utilization(stg).collect()[0]
    assert (u.tot_benes, u.tot_srvcs, u.avg_medicare_payment) == (None, None, None)
    assert u.avg_medicare_allowed == D("90.00")


def test_blank_state_fips_raises(spark):
    stg = _stg(spark, [_line(Rndrng_Prvdr_State_FIPS="")])
    with pytest.raises(Exception):
        loaders.load_providers(stg).collect()


def test_duplicate_npi_one_provider_all_facts(spark):
    rows = [_line(Rndrng_Prvdr_St1="2 OAK AVE", HCPCS_Cd="A1"), _line(Rndrng_Prvdr_St1="1 MAIN ST", HCPCS_Cd="B2")]
    stg = _stg(spark, rows)
    star = loaders.load_star(stg)
    provs = star.providers.collect()
    assert len(provs) == 1 and provs[0].street_1 == "1 MAIN ST"  # smallest row wins, every run
    assert star.codes.count() == 2
    assert star.utilization.count() == 2


def test_duplicate_code_first_description_is_stable(spark):
    rows = [_line(HCPCS_Desc="Zeta"), _line(HCPCS_Desc="Alpha"), _line(HCPCS_Desc="Mid")]
    for _ in range(2):
        got = loaders.load_codes(_stg(spark, rows)).collect()
        assert [(r.hcpcs_cd, r.hcpcs_desc) for r in got] == [("99213", "Alpha")]


def test_codes_do_nothing_on_conflict(spark):
    stg = _stg(spark, [_line(HCPCS_Cd="A1"), _line(HCPCS_Cd="B2")])
    existing = spark.createDataFrame([("A1", "old", "N")], "hcpcs_cd string, hcpcs_desc string, drug_indicator string")
    got = loaders.load_codes(stg, existing=existing).collect()
    assert [r.hcpcs_cd for r in got] == ["B2"]


def test_other_state_filtered_everywhere(spark):
    stg = _stg(spark, [_line(), _line(Rndrng_NPI="2", Rndrng_Prvdr_State_Abrvtn="WI", HCPCS_Cd="W1")])
    star = loaders.load_star(stg, "IL")
    assert [r.npi for r in star.providers.collect()] == [1000000001]
    assert [r.hcpcs_cd for r in star.codes.collect()] == ["99213"]
    assert [r.npi for r in star.utilization.collect()] == [1000000001]


def test_decimal_overflow_raises(spark):
    stg = _stg(spark, [_line(Avg_Mdcr_Pymt_Amt="12345678901.99")])
    with pytest.raises(Exception):
        loaders.load_utilization(stg).collect()


def test_export_roundtrip_keeps_empty_apart_from_null(spark, scratch):
    df = spark.createDataFrame([("a", "", None, D("2.50")), ("b", "x", "y", D("1.00"))],
                               "k string, e string, n string, total_payment decimal(12,2)")
    out = os.path.join(scratch, "export")
    from pyspark.sql import functions as F
    sinks.export_summary(df, out, "csv", order_by=[F.col("total_payment").desc_nulls_first()],
                         single_file=True)
    files = [f for f in os.listdir(out) if f.endswith(".csv")]
    assert len(files) == 1
    text = open(os.path.join(out, files[0]), encoding="utf-8").read().splitlines()
    assert text[0] == "k,e,n,total_payment"
    assert text[1] == 'a,"",,2.50' and text[2] == "b,x,y,1.00"   # sorted by total_payment desc
    assert [c for c, _ in VIEW_ORDER["vw_provider_kpi"]] == ["total_payment", "npi"]
    assert len(view_order("vw_procedure_summary")) == 2


def test_write_and_read_star(spark, scratch):
    stg = _stg(spark, [_line(), _line(Rndrng_NPI="1000000009", HCPCS_Cd="B2")])
    star = loaders.load_star(stg)
    root = os.path.join(scratch, "star")
    sinks.write_star(star, root)
    back = sinks.read_star(spark, root)
    assert back.providers.count() == 2 and back.utilization.count() == 2 and back.by_npi.count() == 2
    assert back.providers.columns == star.providers.columns
    # a later load without roll-ups: nothing of the earlier one is read
    sinks.write_star(loaders.load_star(_stg(spark, [_line(Tot_Srvcs="500")])), root, with_rollups=False)
    again = sinks.read_star(spark, root)
    assert again.by_npi is None and [r.srv for r in again.rollup("npi").collect()] == [D("500.00")]
    # a load that stops between its tables is not seen
    sinks.write_version(star, root, with_rollups=False)
    assert sinks.read_star(spark, root).providers.count() == 1


def test_invalid_utf8_aborts(spark, scratch):
    p = os.path.join(scratch, "enc.csv")
    _write(p, [_line(), _line(Rndrng_NPI="1000000002", Rndrng_Prvdr_City="Z\u00dcRICH \ufffd")])
    assert staging.read_staging(spark, p).count() == 2  # valid text, also a written replacement character
    with open(p, "ab") as fh:  # a line with a byte that is not UTF-8
        good = _line(Rndrng_NPI="1000000003", Rndrng_Prvdr_State_Abrvtn="WI")
        line = ",".join(_csv_field(good[c]) for c in STAGING_COLUMNS)
        fh.write(line.replace("SMITH", "SM\xffITH").encode("latin-1") + b"\n")
    with pytest.raises(ValueError, match="UTF-8"):
        staging.read_staging(spark, p)


@pytest.mark.parametrize("multi_line", [None, True, False])
@pytest.mark.parametrize("n_fields", [20, 27, 29])
def test_malformed_line_of_another_state_aborts_the_load(spark, scratch, n_fields, multi_line):
    p = os.path.join(scratch, "bad.csv")
    other = _line(Rndrng_NPI="2", Rndrng_Prvdr_State_Abrvtn="WI")
    fields = ([_csv_field(other[c]) for c in STAGING_COLUMNS] + ["extra"])[:n_fields]
    _write(p, [_line(), _line(Rndrng_NPI="3")], raw_lines=[",".join(fields)])
    with pytest.raises(Exception, match="malformed extract line"):
        loaders.load_star(staging.read_staging(spark, p, multi_line=multi_line), "IL")
    with pytest.raises(Exception, match="malformed extract line"):
        staging.staging_row_count(staging.read_staging(spark, p, multi_line=multi_line)).collect()


def test_the_extract_decides_whether_it_can_be_split(spark, scratch):
    plain, quoted = os.path.join(scratch, "plain.csv"), os.path.join(scratch, "quoted.csv")
    rows = [_line(Rndrng_NPI=str(i), Rndrng_Prvdr_Last_Org_Name='O"B, C') for i in range(3000)]
    _write(plain, rows)
    _write(quoted, [*rows, _line(HCPCS_Desc="two\nlines")])
    assert staging.inspect_extract(spark, plain) == (0, 0)
    assert staging.inspect_extract(spark, quoted)[0] == 2
    from tests.conftest import assert_same
    assert_same(staging.read_staging(spark, plain), staging.read_staging(spark, plain, multi_line=True))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        assert staging.read_staging(spark, plain).rdd.getNumPartitions() > 1
        assert staging.read_staging(spark, quoted).rdd.getNumPartitions() > 1  # cut by quote parity
        assert staging.read_staging(spark, quoted, multi_line=True).rdd.getNumPartitions() == 1
        assert staging.read_staging(spark, quoted).count() == 3001
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_export_keeps_blanks_at_the_ends(spark, scratch):
    out = os.path.join(scratch, "blanks")
    sinks.export_summary(spark.createDataFrame([(" LAST3 ",)], "n string"), out)
    assert spark.read.option("header", "true").schema("n string").csv(out).collect()[0].n == " LAST3 "


def test_loads_produce_the_declared_schemas(spark):
    from claimlens.schema import CODES_SCHEMA, PROVIDERS_SCHEMA, UTILIZATION_SCHEMA
    star = loaders.load_star(_stg(spark, [_line()]))
    for df, schema in [(star.providers, PROVIDERS_SCHEMA), (star.codes, CODES_SCHEMA),
                       (star.utilization, UTILIZATION_SCHEMA)]:
        assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in schema]


def test_scale_defaults_keep_explicit_settings(spark):
    from claimlens.session import apply_scale_defaults
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64m")
    spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    applied = apply_scale_defaults(spark, {"spark.sql.shuffle.partitions": "4"})
    assert "spark.sql.files.maxPartitionBytes" not in applied
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == "64m"
    assert applied.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "256m"
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"  # set by the test session
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_hot_provider_spreads_over_files(spark, scratch):
    from pyspark.sql import functions as F
    from claimlens.plans.base import Star
    from claimlens.schema import CODES_SCHEMA, PROVIDERS_SCHEMA, UTILIZATION_SCHEMA
    # provider 1 holds two thirds of all facts
    facts = [(1 if i % 3 else 2 + i, f"C{i % 500}", "O", 1, D("1.00"), D("1.00"), D("1.00"),
              D("1.00"), D("1.00"), D("1.00")) for i in range(3000)]
    util = spark.createDataFrame(facts, UTILIZATION_SCHEMA)
    prov = spark.createDataFrame([], PROVIDERS_SCHEMA)
    codes = spark.createDataFrame([], CODES_SCHEMA)
    root = os.path.join(scratch, "star")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as many rows as fill several files
    try:
        sinks.write_star(Star(prov, codes, util), root, with_rollups=False)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    per_file = (sinks.read_star(spark, root).utilization
                .where(F.col("npi") == 1).groupBy(F.input_file_name()).count().collect())
    assert len(per_file) >= 2          # the hot provider is not one task's file


def test_command_line_session_keeps_what_was_submitted(spark, monkeypatch):
    from claimlens import __main__ as cli
    from claimlens.session import cluster_session
    assert cli.cluster_session is cluster_session
    before = spark.sparkContext.master, spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    got = cluster_session()
    try:
        assert (got.sparkContext.master, got.conf.get("spark.sql.shuffle.partitions")) == (before[0], "7")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[1])
        for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes"):
            spark.conf.unset(k)


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]"])
def test_cluster_without_checkpoint_dir_is_an_error(master):
    from claimlens.session import ensure_checkpoint_dir

    class _Conf:
        def get(self, key, default=None):
            return default

    class _Ctx:
        def getCheckpointDir(self):
            return None

        def getConf(self):
            return _Conf()

    _Ctx.master = master

    class _Session:
        sparkContext = _Ctx()
        conf = _Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(_Session())


def test_rollups_of_a_written_star_count_pairs_without_a_second_pass(spark, scratch, monkeypatch):
    """the facts mark each pair once as they are written; null keys, repeated and hot pairs included."""
    from pyspark.sql import types as T

    from claimlens.plans.base import SUM_COLS, Star, roll_up, specialty_codes
    from claimlens.schema import CODES_SCHEMA, PROVIDERS_SCHEMA, UTILIZATION_SCHEMA

    keys = [(1, "A")] * 40 + [(1, "B"), (2, "A"), (2, "A"), (2, None), (2, None), (None, "A"), (None, None), (3, None)]
    names = [f.name for f in UTILIZATION_SCHEMA.fields]
    rows = [tuple({"npi": n, "hcpcs_cd": c, "place_of_service": "F", "tot_benes": 2}.get(x, D("1.50")) for x in names) for n, c in keys]
    util = spark.createDataFrame(rows, T.StructType([T.StructField(f.name, f.dataType) for f in UTILIZATION_SCHEMA.fields]))
    one = [{"npi": n, "provider_type": t} for n, t in ((1, "X"), (2, "X"), (3, None))]
    providers = spark.createDataFrame([tuple(r.get(f.name) for f in PROVIDERS_SCHEMA.fields) for r in one],
                                      T.StructType([T.StructField(f.name, f.dataType) for f in PROVIDERS_SCHEMA.fields]))
    want = [{tuple(r) for r in df.collect()} for df in (roll_up(util, "npi"), roll_up(util, "hcpcs_cd"), specialty_codes(util, providers))]
    monkeypatch.setattr(sinks, "reliable", lambda df: pytest.fail("the pairs are found in a pass of their own"))
    root = os.path.join(scratch, "marked")
    sinks.write_star(Star(providers, spark.createDataFrame([], CODES_SCHEMA), util), root)
    back = sinks.read_star(spark, root)
    assert [{tuple(r) for r in df.collect()} for df in (back.by_npi, back.by_code, back.by_specialty_code)] == want
    assert back.by_npi.columns == ["npi", *SUM_COLS, "n_other"]
    assert sorted(map(str, back.utilization.collect())) == sorted(map(str, util.collect()))
    assert {(r.npi, r.n_other) for r in back.by_npi.collect()} == {(1, 2), (2, 1), (3, 0), (None, 1)}
