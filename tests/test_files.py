import pytest

from kinlink.operators import validate
from kinlink.plans import linkage
from kinlink.plans.params import Params
from kinlink.sources import tsv

HEAD = "source1_entity_id\tmatched_entity_ids\n"


@pytest.fixture
def files(tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text, encoding="utf-8")
        return f"file://{tmp_path / name}"

    return put


def test_scan(spark, files):
    path = files("a.tsv", 'entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\tNA\tnull\tUS\nS1-2\t"A ""B"" Co"\tab"c\t\n')
    rows = tsv.scan(spark, path).orderBy("entity_id").collect()
    assert [tuple(r) for r in rows] == [("S1-1", "", "", "US"), ("S1-2", 'A "B" Co', 'ab"c', "")]
    assert tsv.scan_country(spark, path, "US").count() == 1
    assert {r[0] for r in tsv.scan_ids(spark, path).collect()} == {"S1-1", "S1-2"}
    assert tsv.scan_targets(spark, [path, "file:///nowhere/x.tsv"]) is None


def test_lines_across_splits(spark, files):
    text = "".join(f"line {i} {'x' * (i % 50)}\n" for i in range(1, 3001))
    path = files("lines.tsv", text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        rows = tsv.scan_lines(spark, path)
        assert rows.rdd.getNumPartitions() > 5
        assert all(r.value.split()[1] == str(r.line) for r in rows.collect()) and rows.count() == 3000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_lists_round_trip(spark, files, tmp_path):
    path = files("truth.tsv", HEAD + "S1-2\tS3-1,S2-5\nS1-1\t\n")
    roster, pairs = tsv.scan_truth(spark, path)
    assert roster.count() == 2 and {tuple(r) for r in pairs.collect()} == {("S1-2", "S3-1"), ("S1-2", "S2-5")}
    tsv.write_lists(roster, pairs, f"file://{tmp_path}/out")
    (out,) = (tmp_path / "out").glob("part-*")
    assert out.read_text() == HEAD + "S1-1\t\nS1-2\tS2-5,S3-1\n"


CASES = {
    "good": (HEAD + "S1-1\tS2-1,S3-1\nS1-2\t\n", set()),
    "upper-case header": (HEAD.upper() + "S1-1\tS2-1\nS1-2\t\n", set()),
    "comma header": ("source1_entity_id,matched_entity_ids\nS1-1,S2-1\n", {"comma-separated"}),
    "wrong header": ("a\tb\nS1-1\t\nS1-2\t\n", {"wrong header"}),
    "no tab": (HEAD + "S1-1\t\nS1-2\t\nrubbish\n", {"malformed row"}),
    "blank row": (HEAD + "S1-1\t\n\nS1-2\t\n", set()),
    "duplicate row": (HEAD + "S1-1\t\nS1-1\t\nS1-2\t\n", {"duplicate row"}),
    "duplicate id": (HEAD + "S1-1\tS2-1,S2-1\nS1-2\t\n", {"duplicate id in list"}),
    "own source": (HEAD + "S1-1\tS1-2\nS1-2\t\n", {"id of the reference source"}),
    "prefix": (HEAD + "S1-1\tS4-1\nS1-2\t\n", {"wrong prefix"}),
    "blank in list": (HEAD + "S1-1\tS2-1, S3-1\nS1-2\t\n", {"wrong prefix"}),
    "trailing comma": (HEAD + "S1-1\tS2-1,\nS1-2\t\n", {"wrong prefix"}),
    "missing": (HEAD + "S1-1\t\n", {"missing entity"}),
    "unexpected": (HEAD + "S1-1\t\nS1-2\t\nS1-3\t\n", {"unexpected entity"}),
    "unknown": (HEAD + "S1-1\tS2-77\nS1-2\t\n", {"unknown id"}),
}


@pytest.mark.parametrize("case", CASES)
def test_file_checks(spark, files, case):
    text, expected = CASES[case]
    required = spark.createDataFrame([("S1-1",), ("S1-2",)], "entity_id string")
    valid = spark.createDataFrame([("S2-1",), ("S3-1",)], "entity_id string")
    report, _ = validate.check_file(spark, files("m.tsv", text), "matching", required, valid)
    assert {r.check for r in report.collect()} == expected


def test_validate(spark, files):
    s1 = files("s1.tsv", "entity_id\tbusiness_name\nS1-1\tx\nS1-2\ty\n")
    good = files("m.tsv", HEAD + "S1-1\tS2-1\nS1-2\t\n")
    offered = files("c.tsv", "source1_entity_id\tcandidate_entity_ids\nS1-1\tS2-2\nS1-2\t\n")
    assert {(r.check, r.severity) for r in validate.validate(spark, good, offered, s1).collect()} == {("match is no candidate", "warning")}
    assert {r.severity for r in validate.validate(spark, good, "file:///nowhere.tsv", s1).collect()} == {"warning"}
    assert {r.check for r in validate.validate(spark, "file:///nowhere.tsv", None, s1).collect()} == {"missing file"}
    assert validate.validate_quick(spark, good, s1).count() == 0
    assert {r.check for r in validate.validate_quick(spark, files("u.tsv", HEAD.upper() + "S1-1\t\nS1-2\t\n"), s1).collect()} == {"wrong header"}
    assert {r.check for r in validate.validate(spark, good, None, s1, ["file:///nowhere.tsv"], check_ids=True).collect()} == {"ids not checked: target file missing"}


def test_whole_run(spark, files, tmp_path):
    head = "entity_id\tbusiness_name\tbusiness_address\tcountry\n"
    name = lambda i: f"{'abcdefghij'[i % 10] * 3} {'klmnopqrst'[i // 10 % 10] * 4} {i} works"
    for kind, n in (("train", 120), ("test", 40)):
        files(f"{kind}_source1.tsv", head + "".join(f"S1-{i}\t{name(i)} Ltd\t{i} Main St\tUS\n" for i in range(n)))
        files(f"{kind}_source2.tsv", head + "".join(f"S2-{i}\t{name(i)}\t{i} Main St\tUS\n" for i in range(0, n, 2)))
        files(f"{kind}_source3.tsv", head + "".join(f"S3-{i}\t{name(i)} Inc\t{i} Main Street\tUS\n" for i in range(0, n, 3)))
    files("train_ground_truth.tsv", HEAD + "".join(f"S1-{i}\t{','.join([f'S2-{i}'] * (i % 2 == 0) + [f'S3-{i}'] * (i % 3 == 0))}\n" for i in range(120)))
    d = f"file://{tmp_path}"
    trained = linkage.run(spark, d, d, f"{d}/out", Params(trees=5, depth=3, min_leaf=2))
    assert trained.metrics.first().macro_f05 > 0.9 and trained.candidate_recall.first().recall > 0.9
    (matching,), (offered,) = ((tmp_path / "out" / x).glob("part-*") for x in ("matching_results", "candidate_pairs"))
    report = validate.validate(spark, f"file://{matching}", f"file://{offered}", f"{d}/test_source1.tsv", [f"{d}/test_source2.tsv", f"{d}/test_source3.tsv"], check_ids=True)
    assert report.count() == 0
    (told,) = (tmp_path / "out" / "report").glob("part-*")
    told = dict(x.split("\t") for x in told.read_text().splitlines())
    assert told["records"] == "40" and int(told["training n"]) == int(told["training positives"]) + int(told["training negatives"])
    assert float(told["threshold"]) == trained.threshold and sum(k.startswith("importance ") for k in told) == 15 and "validation macro_f05" in told
    lines = matching.read_text().splitlines()
    assert [x.split("\t")[0] for x in lines[1:]] == [f"S1-{i}" for i in range(40)]  # in the order of the input


def test_ids_skip_the_header_by_place(spark, files):
    path = files("other.tsv", 'key\tbusiness_name\nS1-1\tx\n"S1-2\ty\n\tz\nentity_id\tq\n')
    assert {r[0] for r in tsv.scan_ids(spark, path).collect()} == {"S1-1", '"S1-2', "entity_id"}


def test_lines_of_several_files(spark, files, tmp_path):
    for k in range(3):
        files(f"part-{k}.txt", "".join(f"{k * 4 + i}\n" for i in range(1, 5)))
    assert sorted((r.line, int(r.value)) for r in tsv.scan_lines(spark, f"file://{tmp_path}/part-*").collect()) == [(i, i) for i in range(1, 13)]


def test_command_line(spark, files, tmp_path, capsys):
    s1 = files("s1.tsv", "entity_id\tbusiness_name\nS1-1\tx\nS1-2\ty\n")
    good = files("m.tsv", HEAD + "S1-1\tS2-1,S3-4\nS1-2\t\n")
    assert validate.main([good, "--test-s1", s1]) == 0
    out = capsys.readouterr().out
    assert "2 rows, 1 with and 1 without ids" in out and out.endswith("PASS\n")
    assert validate.main([good, "--test-s1", f"file://{tmp_path}/nowhere.tsv"]) == 1 and capsys.readouterr().out.endswith("FAIL\n")
    assert validate.main([f"file://{tmp_path}/nowhere.tsv", "--test-s1", s1]) == 1 and "missing file" in capsys.readouterr().out
    (tmp_path / "bad.tsv").write_bytes(HEAD.encode() + b"S1-1\tS2-\xff\nS1-2\t\n")
    assert validate.main([f"file://{tmp_path}/bad.tsv", "--test-s1", s1]) == 1 and "not UTF-8: 1 (2)" in capsys.readouterr().out


def test_digits_of_any_script(spark):
    from kinlink.functions import text as tx

    row = spark.createDataFrame([("१२ main st 34b",)], "a string").select(tx.addr_numbers(tx.F.col("a")).alias("n")).first()
    assert row.n == ["१२", "34"]
