from __future__ import annotations

import json

import pytest

from cairngraph import agent
from cairngraph.sources import tasks


def test_cells_drop_outputs_and_literal_answers():
    assert agent.cells("```python\nx = 1\n```\n```\nProcessed 6 cast members.\n```") == ["x = 1\n"]
    assert agent.cells("```python\nx = f()\n```\n```python\nFINAL({'a': 1})\n```") == ["x = f()\n"]
    assert len(agent.cells("```python\nx = 1\n```\n```python\ny = 2\n```")) == 2
    assert agent.cells("no code") == []


def test_run_cell_echoes_and_keeps_names():
    names: dict = {}
    assert agent.run_cell("a = 2\na + 3", names) == "5\n" and names["a"] == 2
    assert "in quotes" in agent.run_cell("Q42", names)
    assert "ZeroDivisionError" in agent.run_cell("1/0", names)
    with pytest.raises(agent.Final):
        agent.run_cell("FINAL(1)", {"FINAL": lambda v: (_ for _ in ()).throw(agent.Final(v))})


def test_loop_statuses():
    replies = iter(["```python\nx = read()\n```", "prose only", "```python\nFINAL({'n': x})"])
    run = agent.run_loop(lambda _: next(replies), "p", "q", {"read": lambda: 7}, 5, {"n": 1})
    assert (run.status, run.turns, json.loads(run.answer)) == ("final", 3, {"n": 7})
    assert agent.run_loop(lambda _: "```python\n1\n```", "p", "q", {}, 2).status == "max_iters"

    def broken(_):
        raise ValueError

    assert agent.run_loop(broken, "p", "q", {}, 2).status == "crashed:ValueError"
    stubborn = agent.run_loop(lambda _: "```python\nFINAL([1])\n```", "p", "q", {}, 2, {"n": 1})
    assert stubborn.status == "max_iters" and "Not accepted" in stubborn.messages[-1]["content"]


def test_shape_faults():
    assert agent.shape_fault("[1]", {"a": 1}) and agent.shape_fault('{"b": 1}', {"a": 1}) and agent.shape_fault("{", {"a": 1})
    assert agent.shape_fault('{"a": ["Paris"]}', {"a": ["Q90"]}) and agent.shape_fault('{"a": ["Q1"]}', {"a": ["Q90"]}) is None


def test_ids_and_quotes():
    assert agent.ungrounded_ids("Q1 Q2 geneQ9", "about Q1", {"Q3"}) == ["Q2"]
    assert agent.recalled_ids("x = edges('Q5')\ny = 'Q6'", "Q6?", set()) == ["Q5"]
    assert agent.closest_quote("it says: a long text.", ["a", "a long text", "other"]) == "a long text"


def test_map_over_reports_missing_keys():
    assert agent.map_over(lambda p: "0\tyes\nx\tno", ["a", "b"], "?") == {"0": "yes", "1": "NO ANSWER"}
    asked: list = []
    agent.map_over(lambda p: asked.append(p) or "", {str(i): i for i in range(25)}, "?", 10)
    assert len(asked) == 3


def test_read_log_charges():
    log = agent.ReadLog(budget=3)
    log.add("edges", ["Q1", "both", None], ["Q1", "Q2"])
    log.add("name", ["Q2"], ["Q2"])  # seen: free
    log.add("has", ["Q99"], [])  # a miss is free
    log.add("edges", ["Q1", "out", "5"], ["Q2"])  # opened in full before: free
    assert log.spent == 1 and log.left() == 2
    log.add("claims", ["Q1"], []), log.add("claims", ["Q1"], [])
    with pytest.raises(agent.BudgetExhausted):
        log.add("claims", ["Q1"], [])


def test_retry():
    tries: list = []

    def call():
        tries.append(1)
        if len(tries) < 3:
            raise ConnectionError
        return "ok"

    assert agent.with_retry(call, lambda e: isinstance(e, ConnectionError), sleep=lambda s: None) == "ok"
    with pytest.raises(ValueError):
        agent.with_retry(lambda: (_ for _ in ()).throw(ValueError()), lambda e: False, sleep=lambda s: None)


def test_contract():
    task = {"id": "a", "question": "b", "taxonomy": {"category": "c", "type": "d"}, "allowed_functions": ["has"], "limits": {"turns": 3}, "answer": {"schema": "s", "format": "f", "expected": None}}
    assert tasks.contract_faults(task, ["has"]) == []
    assert tasks.contract_faults({**task, "limits": {"turns": 3, "reads": 1}}, ["has"]) and tasks.contract_faults({**task, "allowed_functions": ["x"]}, ["has"])
    assert tasks.contract_faults({"id": "a"}, []) and tasks.contract_faults([], [])


def test_env_files(tmp_path, monkeypatch):
    (tmp_path / "a.env").write_text("X=1\nexport Y='2'\n# no\n")
    (tmp_path / "b.env").write_text("X=9\nZ=3\n")
    monkeypatch.setenv("Z", "shell")
    assert tasks.env_files(tmp_path / "a.env", tmp_path / "b.env", defaults={"X": "0", "W": "4"}) == {"X": "1", "Y": "2", "Z": "shell", "W": "4"}


def test_task_files_and_archive(spark, tmp_path):
    folder = tmp_path / "tasks/cards"
    folder.mkdir(parents=True)
    (folder / "T1.json").write_text(json.dumps({"id": "T1", "question": "q", "taxonomy": {"category": "c", "type": "t"}, "allowed_functions": ["has"], "limits": {"turns": 4}, "answer": {"schema": "s", "format": "f", "expected": {"n": 1}}}, indent=1))
    found = tasks.read_tasks(spark, str(tmp_path / "tasks"))
    row = found.withColumn("valid", tasks.valid_contract()).first()
    assert (row["task"], row["family"], row["turns"], json.loads(row["expected"]), row["valid"]) == ("T1", "cards", 4, {"n": 1}, True)
    tasks.archive(spark, str(tmp_path / "runs"), "T1_20240101_000000_1", {"a": 1}, [{"role": "user", "content": "x"}], [{"fn": "has", "args": ["Q1"], "ids": []}])
    scores = spark.createDataFrame([("T1_20240101_000000_1", True)], "run string, exact boolean")
    assert tasks.catalogue(spark, str(tmp_path / "runs"), found, scores).first()["family"] == "cards"
    assert [p.name for p in tasks.discover(tmp_path / "tasks", ["cards", "cards"], 1)] == ["T1.json"]
