"""What rests on question and evidence is told once a case, not once a phase, and gives what evaluating each phase alone gives."""

from caselens.operators import phases, quality

COLUMNS = "case_id string, question string, evidence array<string>, insufficient_reasons array<string>, expected_decision string, expected_unsupported int, answers map<string,string>"
ROWS = [
    ("a", "Validateへアップロードするコマンドは?", ["qacli validate build v1.2 IDE Plugin", "version 1.3 windows"], [], "Blocked", 1, {"x": "qacli validate build --force ERR-404", "y": "portal", "z": None}),
    ("b", None, None, None, "Blocked", 0, {"x": "Stream license", "y": "", "z": "API"}),
    ("c", "ライセンス how to", [None, "IDEプラグイン"], ["VersionMismatch"], None, 0, {"x": "ライセンス", "y": "port 8080", "z": "/a/b/c.txt"}),
]


def test_cases_are_supported_once(spark, monkeypatch):
    cases = spark.createDataFrame(ROWS, COLUMNS)
    names = ["x", "y", "z"]
    alone = []
    for name in names:
        rows = cases.selectExpr("*", f"'{name}' AS phase", f"answers['{name}'] AS answer").drop("answers")
        alone += [(r["case_id"], r["phase"], r["decision"], r["grounding"], r["conflicts"], sorted(map(tuple, r["unsupported"]))) for r in quality.evaluated(rows).collect()]
    kept = {}

    def written(df, name, write=quality.written):
        kept[name] = write(df, name)
        return kept[name]

    monkeypatch.setattr(quality, "written", written)
    found = phases.phase_answers(cases, names)
    assert not {c for c in found.columns if c.startswith("_")}
    got = [(r["case_id"], r["phase"], r["decision"], r["grounding"], r["conflicts"], sorted(map(tuple, r["unsupported"]))) for r in found.collect()]
    key = lambda r: r[:2]
    assert sorted(got, key=key) == sorted(alone, key=key) and len(got) == 9 and len({r[2] for r in got}) > 1
    assert kept["supported"].count() == 3 and kept["answers"].count() == 9
