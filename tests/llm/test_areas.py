import random

from locusloom.llm.areas import AreaModel, area_model, assign_areas, fit_areas, sections, word_features

VOCAB = {
    "sport": ["goal", "referee", "stadium", "league", "striker", "relay", "podium", "umpire"],
    "law": ["statute", "tribunal", "verdict", "plaintiff", "docket", "appeal", "clause", "covenant"],
}
PLAIN = ["index", "buffer", "table", "offset", "record", "list", "view", "handler", "mode"]


def commit(rng, area, shape):
    w = lambda: rng.choice(VOCAB[area]) if area and rng.random() < 0.5 else rng.choice(PLAIN)
    head = {"git": "commit 0123456789abcdef\nAuthor: a <a@x>\nDate:   d\n\n    fix {0} {1}\n", "svn": "-----\nr12 | a | d\n\nfix {0} {1}\n"}[shape].format(w(), w())
    return head + f"\ndiff --git a/lib/{w()}/{w()}.py b/x\nindex 1..2 100644\n--- a/x\n+++ b/x\n@@ -1,3 +1,3 @@ def {w()}():\n context stadium\n+{w()}_{w()} = {w()}\n-{w()}{w().title()}()\n"


def test_sections():
    msg, paths, changed, meta = sections(commit(random.Random(1), "law", "git"))
    assert "Author" not in msg and "fix" in msg and paths.startswith("lib/") and "context" not in changed and meta.startswith(" def")
    assert sections("") == ("", "", "", "")
    assert "límite" in sections("\n\nlÃ\xadmite x Ã")[0]
    assert sections("no diff at all")[0] == "no diff at all"
    assert sections("diff --git a/p b/p\n+x\n")[1] == "p"


def test_changed_lines_that_look_like_file_marks_are_kept():
    one = "diff --git a/q.sql b/q.sql\nindex 1..2 100644\n--- a/nameofold\n+++ b/nameofnew\n@@ -1,2 +1,2 @@\n--- verdict of the tribunal\n+-- appeal\n+++ referee\n@@ -9 +9 @@\n--- a/docket\n"
    two = "diff --git a/x b/x\nBinary files a/x and b/x differ\ndiff --git a/y b/y\n--- /dev/null\n+++ b/nameofnew"
    _, paths, changed, _ = sections("fix\n\n" + one + two)
    assert changed.split("\n") == ["--- verdict of the tribunal", "+-- appeal", "+++ referee", "--- a/docket", ""] and paths == "q.sql\nx\ny"


def test_held_out_accuracy():
    rng = random.Random(3)
    docs = [(commit(rng, a, rng.choice(["git", "svn"])), {a} if a else set()) for a in [rng.choice(["sport", "law", None]) for _ in range(900)]]
    model = fit_areas(docs[:400], [t for t, _ in docs[400:600]], ["law", "sport"], bits=14)
    right = sum(set(model.pick(model.scores(word_features(t, 14)))) == s for t, s in docs[600:])
    assert right / 300 > 0.9


def test_spark_path_and_edge_cases(spark):
    rng = random.Random(5)
    rows = [(i, commit(rng, a, "git"), a or "none") for i, a in enumerate(rng.choice(["sport", "law", None]) for _ in range(200))]
    docs = spark.createDataFrame([(i, t, "clash", 1.0) for i, t, _ in rows] + [(500, None, "x", 0.0), (501, "", "x", 0.0), (None, rows[0][1], "x", 0.0), (0, rows[0][1], "x", 0.0)], "doc_id long, text string, area string, score double")
    labels = spark.createDataFrame([(i, f" {a.upper()}\t") for i, _, a in rows[:120]] + [(None, "law"), (777, "law"), (3, None)], "doc_id long, area string")
    model = area_model(docs, labels, ["law", "sport"], label_rows=100, weak_rows=60)
    got = assign_areas(docs, model).collect()
    found = {(r["doc_id"], r["area"]) for r in got}
    right = sum({a for j, a in found if j == i} == ({a} - {"none"}) for i, _, a in rows[1:])
    assert right > 170 and not {500, 501} & {i for i, _ in found}
    assert sum(r["doc_id"] == 0 for r in got) == 2 * sum(r["doc_id"] is None for r in got)
    assert assign_areas(docs.limit(0), model).count() == 0
    empty = area_model(docs, labels.limit(0), ["law", "sport"])
    assert isinstance(empty, AreaModel) and assign_areas(docs, empty).count() == 0


def test_long_text_has_features():
    assert len(word_features("goal " * 200_000)) <= 2
