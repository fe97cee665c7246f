"""Incremental loading: files arriving over time give the one-shot load;
replayed batches are idempotent."""

import os

from pyspark.sql import functions as F

from claimlens.operators import kpis
from claimlens.sources import loaders, staging
from claimlens.streaming.ingest import load_batch, read_loaded, start_ingest
from tests.conftest import assert_same
from tests.test_sources import _line, _stg, _write


def test_files_arriving_over_time(spark, scratch):
    src = os.path.join(scratch, "incoming")
    os.makedirs(src)
    target = os.path.join(scratch, "star")
    ckpt = os.path.join(scratch, "ckpt")
    _write(os.path.join(src, "part-2023a.csv"), [
        _line(Rndrng_NPI="1", Rndrng_Prvdr_St1="1 FIRST ST", HCPCS_Cd="A1", HCPCS_Desc="first"),
        _line(Rndrng_NPI="2", HCPCS_Cd="B2"),
        _line(Rndrng_NPI="9", Rndrng_Prvdr_State_Abrvtn="WI", HCPCS_Cd="W9"),
    ])
    q = start_ingest(spark, src, target, checkpoint_location=ckpt)
    q.awaitTermination(120)
    star = read_loaded(spark, target)
    assert sorted(r.npi for r in star.providers.collect()) == [1, 2]
    assert star.utilization.count() == 2

    # a second file: a known NPI with a new address, a known code with a new text
    _write(os.path.join(src, "part-2023b.csv"), [
        _line(Rndrng_NPI="1", Rndrng_Prvdr_St1="0 NEW ST", HCPCS_Cd="A1", HCPCS_Desc="changed"),
        _line(Rndrng_NPI="3", HCPCS_Cd="C3"),
    ])
    q = start_ingest(spark, src, target, checkpoint_location=ckpt)
    q.awaitTermination(120)
    star = read_loaded(spark, target)
    provs = {r.npi: r.street_1 for r in star.providers.collect()}
    assert provs == {1: "0 NEW ST", 2: "1 MAIN ST", 3: "1 MAIN ST"}   # smallest row over all files
    codes = {r.hcpcs_cd: r.hcpcs_desc for r in star.codes.collect()}
    assert codes == {"A1": "changed", "B2": "Office visit", "C3": "Office visit"}
    assert star.utilization.count() == 4                                  # every fact line kept
    # exactly what one load over both files gives
    once = loaders.load_star(staging.read_staging(spark, src), stage=False)
    assert_same(star.providers, once.providers)
    assert_same(star.codes, once.codes)
    assert_same(star.utilization.drop("load_batch"), once.utilization)
    assert star.utilization.select(F.countDistinct("load_batch")).first()[0] == 2

    # nothing new: no batch, nothing changes
    q = start_ingest(spark, src, target, checkpoint_location=ckpt)
    q.awaitTermination(120)
    assert read_loaded(spark, target).utilization.count() == 4
    # and the KPI operators run on the incrementally loaded star
    assert kpis.specialty_spend(read_loaded(spark, target)).count() == 1


def test_replayed_batch_is_idempotent(spark, scratch):
    target = os.path.join(scratch, "star")
    stg = _stg(spark, [_line(Rndrng_NPI="1", HCPCS_Cd="A1"), _line(Rndrng_NPI="2", HCPCS_Cd="A1")])
    for _ in range(2):  # e.g. the batch is retried after a lost executor
        load_batch(stg, 0, target)
    star = read_loaded(spark, target)
    assert star.providers.count() == 2 and star.codes.count() == 1 and star.utilization.count() == 2


def test_compaction_keeps_results(spark, scratch):
    from claimlens.streaming.ingest import compact
    target = os.path.join(scratch, "star")
    batches = [
        [_line(Rndrng_NPI="1", Rndrng_Prvdr_St1="5 ELM ST", HCPCS_Cd="A1", HCPCS_Desc="zeta")],
        [_line(Rndrng_NPI="1", Rndrng_Prvdr_St1="2 ELM ST", HCPCS_Cd="A1", HCPCS_Desc="beta"),
         _line(Rndrng_NPI="2", HCPCS_Cd="B2")],
        [_line(Rndrng_NPI="1", Rndrng_Prvdr_St1="9 ELM ST", HCPCS_Cd="A1", HCPCS_Desc="alpha")],
    ]
    load_batch(_stg(spark, batches[0]), 0, target)
    load_batch(_stg(spark, batches[1]), 1, target)
    assert compact(spark, target) == 1
    load_batch(_stg(spark, batches[2]), 2, target)      # arrives after the compaction
    star = read_loaded(spark, target)
    once = loaders.load_star(_stg(spark, [r for b in batches for r in b]), stage=False)
    assert_same(star.providers, once.providers)
    assert_same(star.codes, once.codes)
    assert {r.npi: r.street_1 for r in star.providers.collect()}[1] == "2 ELM ST"
    assert {r.hcpcs_cd: r.hcpcs_desc for r in star.codes.collect()}["A1"] == "alpha"
    assert compact(spark, target) == 2 and read_loaded(spark, target).providers.count() == 2
    assert compact(spark, target) == 2                   # nothing new: a no-op
    assert_same(read_loaded(spark, target).providers, once.providers)


def test_restart_in_another_session_resumes(spark, scratch):
    """No checkpoint location given: a second process finds the first one's progress."""
    import subprocess
    import sys
    src, target = os.path.join(scratch, "incoming"), os.path.join(scratch, "star")
    os.makedirs(src)
    run = ("import sys; from claimlens.session import build_session; from claimlens.streaming.ingest import start_ingest; "
           "s = build_session('local[2]', 2, extra={'spark.checkpoint.dir': sys.argv[3]}); "
           "start_ingest(s, sys.argv[1], sys.argv[2]).awaitTermination(); s.stop()")
    env = {**os.environ, "PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__)))}
    for name, npi in (("a.csv", "1"), ("b.csv", "2"), (None, None)):
        if name:
            _write(os.path.join(src, name), [_line(Rndrng_NPI=npi, HCPCS_Cd="A" + npi)])
        subprocess.run([sys.executable, "-c", run, src, target, os.path.join(scratch, "ckpt")], check=True, env=env, timeout=240)
    star = read_loaded(spark, target)
    assert sorted(r.npi for r in star.utilization.collect()) == [1, 2]


def test_batch_cut_between_its_writes(spark, scratch, monkeypatch):
    from claimlens.streaming import ingest
    target = os.path.join(scratch, "star")
    first, second = [_line(Rndrng_NPI="1", HCPCS_Cd="A1")], [_line(Rndrng_NPI="2", HCPCS_Cd="B2")]
    load_batch(_stg(spark, first), 0, target)
    real = ingest._write_batch

    def cut(df, path, batch):
        if path.endswith(ingest.CODE_CANDIDATES):
            raise OSError("lost")
        real(df, path, batch)

    monkeypatch.setattr(ingest, "_write_batch", cut)
    try:
        load_batch(_stg(spark, second), 1, target)
    except OSError:
        pass
    monkeypatch.setattr(ingest, "_write_batch", real)
    assert [r.npi for r in read_loaded(spark, target).providers.collect()] == [1]  # the cut batch is not read
    assert ingest.compact(spark, target) == 0
    load_batch(_stg(spark, second), 1, target)  # the retry
    for _ in range(2):
        star, once = read_loaded(spark, target), loaders.load_star(_stg(spark, first + second), stage=False)
        assert_same(star.codes, once.codes)
        assert_same(star.providers, once.providers)
        assert star.utilization.count() == 2
        assert ingest.compact(spark, target) == 1


def test_batches_without_a_line_of_the_state(spark, scratch):
    target = os.path.join(scratch, "star")
    load_batch(_stg(spark, [_line(Rndrng_Prvdr_State_Abrvtn="WI")]), 0, target)
    star = read_loaded(spark, target)
    assert (star.providers.count(), star.codes.count(), star.utilization.count()) == (0, 0, 0)
    load_batch(_stg(spark, [_line()]), 1, target)
    assert read_loaded(spark, target).utilization.count() == 1


def _lines(n, **over):
    return [_line(Rndrng_NPI=str(1 + i % 7), HCPCS_Cd=f"C{i % 5}", Tot_Srvcs=str(10 + i), Rndrng_Prvdr_Type=f"S{i % 7 % 3}", **over) for i in range(n)]


def test_rollups_are_sums_over_batches(spark, scratch):
    from claimlens.operators import summaries
    from claimlens.streaming import ingest
    target = os.path.join(scratch, "star")
    rows = _lines(40) + [_line(Rndrng_NPI="50", HCPCS_Cd="C1", Tot_Srvcs=""), _line(Rndrng_NPI="1", HCPCS_Cd="NEW")]
    once = loaders.load_star(_stg(spark, rows), stage=False)
    for b, (lo, hi) in enumerate([(0, 9), (9, 10), (10, 30), (30, 42)]):  # compacted in between
        assert load_batch(_stg(spark, rows[lo:hi]), b, target)
        if b == 2:
            assert ingest.compact(spark, target) == 2
    star = read_loaded(spark, target)
    assert star.by_npi is not None
    for name, want in ingest.rollup_tables(once).items():
        assert_same(ingest.rollup_tables(star)[name], want)
    assert_same(summaries.vw_specialty_summary(star), summaries.vw_specialty_summary(once))
    assert ingest.compact(spark, target) == 3
    star = read_loaded(spark, target)
    for name, want in ingest.rollup_tables(once).items():
        assert_same(ingest.rollup_tables(star)[name], want)
    # reading the roll-ups reads no fact, and neither does a batch beyond its own
    for df in (star.by_npi, star.by_code, star.by_specialty_code):
        assert not [f for f in df.inputFiles() if f"/{ingest.FACTS}/" in f]
    mine = _stg(spark, rows[:3])
    shares = ingest.batch_rollups(loaders.load_utilization(mine), ingest._current(spark, target, ingest.PAIRS, before=4))
    assert not [f for df in shares for f in df.inputFiles() if f"/{ingest.FACTS}/" in f]


def test_a_retried_batch_counts_its_pairs_once(spark, scratch, monkeypatch):
    from claimlens.streaming import ingest
    target = os.path.join(scratch, "star")
    assert load_batch(_stg(spark, _lines(6)), 0, target)
    real = ingest._commit
    monkeypatch.setattr(ingest, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    try:
        load_batch(_stg(spark, _lines(12)), 1, target)  # all tables are written, the commit is not
    except OSError:
        pass
    monkeypatch.setattr(ingest, "_commit", real)
    assert read_loaded(spark, target).utilization.count() == 6
    assert load_batch(_stg(spark, _lines(12)), 1, target)
    once = loaders.load_star(_stg(spark, _lines(6) + _lines(12)), stage=False)
    for name, want in ingest.rollup_tables(once).items():
        assert_same(ingest.rollup_tables(read_loaded(spark, target))[name], want)


def test_violating_batches_are_quarantined(spark, scratch):
    from claimlens.streaming import ingest
    target = os.path.join(scratch, "star")
    assert load_batch(_stg(spark, [_line(Rndrng_NPI="1")]), 0, target)
    bad = {
        "unique.npi": [_line(Rndrng_NPI="01")],                                # the number of another batch's text
        "not_null.hcpcs_cd": [_line(Rndrng_NPI="2", HCPCS_Cd=None)],
        "length.zip5": [_line(Rndrng_NPI="2", Rndrng_Prvdr_Zip5="60601-1234")],
        "type.Tot_Srvcs": [_line(Rndrng_NPI="2", Tot_Srvcs="many")],
        "type.state_fips": [_line(Rndrng_NPI="2", Rndrng_Prvdr_State_FIPS="")],
    }
    for b, rows in enumerate(bad.values(), 1):
        assert not load_batch(_stg(spark, rows), b, target)
    assert not load_batch(_stg(spark, [_line(Rndrng_NPI="3"), _line(Rndrng_NPI="003")]), 6, target)
    assert load_batch(_stg(spark, [_line(Rndrng_NPI="4"), _line(Rndrng_NPI="5", Rndrng_Prvdr_State_Abrvtn="WI", HCPCS_Cd=None)]), 7, target)
    star = read_loaded(spark, target)
    assert sorted(r.npi for r in star.providers.collect()) == [1, 4]
    assert sorted(r.npi for r in star.by_npi.collect()) == [1, 4] and star.utilization.count() == 2
    got = {(r.load_batch, r.reason) for r in ingest.quarantined(spark, target).collect()}
    assert got == {*((b, name) for b, name in enumerate(bad, 1)), (6, "unique.npi")}
    assert ingest.compact(spark, target) == 7 and read_loaded(spark, target).providers.count() == 2


def test_bad_files_are_quarantined_and_a_restart_goes_on(spark, scratch):
    from claimlens.streaming import ingest
    src, target = os.path.join(scratch, "incoming"), os.path.join(scratch, "star")
    os.makedirs(src)

    def run():
        start_ingest(spark, src, target, max_files_per_trigger=1).awaitTermination()

    _write(os.path.join(src, "a.csv"), [_line(Rndrng_NPI="1", HCPCS_Desc="two\nlines")])
    run()
    _write(os.path.join(src, "b.csv"), [_line(Rndrng_NPI="2")], raw_lines=["1,2,3"])            # a short line
    run()
    with open(os.path.join(src, "c.csv"), "wb") as fh:
        fh.write(b"header\nSM\xffITH\n")                                                        # not UTF-8
    run()
    _write(os.path.join(src, "d.csv"), [_line(Rndrng_NPI="01")])                                # another text of NPI 1
    run()
    _write(os.path.join(src, "e.csv"), [_line(Rndrng_NPI="2")])
    run()
    run()                                                                                       # nothing new
    star = read_loaded(spark, target)
    assert sorted(r.npi for r in star.utilization.collect()) == [1, 2]
    assert {r.hcpcs_desc for r in star.codes.collect()} == {"Office visit"}  # the smallest over the batches
    got = {(os.path.basename(r.file), r.reason.split(":")[0]) for r in ingest.quarantined(spark, target).collect()}
    assert got == {("b.csv", "malformed"), ("c.csv", "unreadable"), ("d.csv", "unique.npi")}


def test_a_batch_cut_while_it_is_quarantined(spark, scratch, monkeypatch):
    from claimlens.streaming import ingest
    target = os.path.join(scratch, "star")
    assert load_batch(_stg(spark, [_line(Rndrng_NPI="1")]), 0, target)
    real = ingest._commit
    monkeypatch.setattr(ingest, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    try:
        load_batch(_stg(spark, [_line(Rndrng_NPI="01")]), 1, target)
    except OSError:
        pass
    monkeypatch.setattr(ingest, "_commit", real)
    assert not load_batch(_stg(spark, [_line(Rndrng_NPI="01")]), 1, target)                     # the retry ends the same way
    assert ingest.quarantined(spark, target).count() == 1
    assert read_loaded(spark, target).providers.count() == 1
