"""Prompts from graph and documents, and the checks of a whole data set."""

from tessera.operators import answering, gates


def test_answer_prompts_leave_out_what_is_missing(spark):
    questions = spark.createDataFrame([(1, "Who?"), (2, "What?"), (3, None)], "query_id long, question string")
    reached = spark.createDataFrame([(1, "a", "Ann", "Person"), (1, "b", None, None), (1, "b", None, None), (2, "a", "Ann", "Person")], "query_id long, id string, name string, type string")
    edges = spark.createDataFrame([("a", "b", "KNOWS"), ("a", "b", "KNOWS"), ("b", "c", "OWNS"), ("b", "a", None)], "src string, dst string, type string")
    excerpts = spark.createDataFrame([(1, 1, "x" * 501, 0.5), (1, 2, "short", 0.9), (1, 3, "no", 0.5), (1, 4, "left out", 0.1), (3, 9, None, None)], "query_id long, doc_id long, text string, similarity double")
    got = {r.query_id: r.prompt.split("\n\n") for r in answering.answer_prompt(questions, reached, edges, excerpts).collect()}
    assert got[1][0] == "QUESTION: Who?" and got[1][1] == "ENTITIES:\n- Ann (Person)\n- Unknown (Entity)"
    assert got[1][2] == "RELATIONSHIPS:\n- Ann KNOWS Unknown\n- Unknown RELATED_TO Ann"
    assert got[1][3] == "DOCUMENTS:\n[similarity 0.90] short\n[similarity 0.50] " + "x" * 500 + "...\n[similarity 0.50] no"
    assert [p.split("\n")[0] for p in got[2][:-1]] == ["QUESTION: What?", "ENTITIES:"] and got[3][1] == "DOCUMENTS:\n[similarity 0.00] "
    few = answering.answer_prompt(questions.where("query_id = 1"), reached, edges, excerpts, most_nodes=1, most_edges=1, most_excerpts=1, length=2).first().prompt
    assert few.count("\n- ") == 2 and "sh..." in few and "left out" not in few


def test_checks_of_a_data_set(spark):
    rows = [("List it all.", "", "1. yes")] * 3 + [("Explain gravity.", None, "It falls.")] + [("Solve this.", "", " ")] + [(None, "", "x")]
    df = spark.createDataFrame(rows, "instruction string, input string, output string")
    got = {r.item: r for r in gates.dataset_checklist(df, least=6).collect()}
    assert (got["size"].value, got["size"].ok) == (6.0, True)
    assert (got["balance"].value, got["balance"].ok) == (0.5, True)
    assert abs(got["duplicates"].value - 2 / 6) < 1e-9 and not got["duplicates"].ok
    assert (got["format"].value, got["format"].ok) == (0.5, False)
    none = {r.item: r for r in gates.dataset_checklist(df.limit(0)).collect()}
    assert none["size"].value == 0 and not any(r.ok for r in none.values() if r.item in ("size", "format", "balance"))
