import json

from tessergrid.__main__ import main


def test_list_and_run(spark, capsys):
    assert main(["list"]) == 0 and "rrf_fusion T10" in capsys.readouterr().out
    assert main(["run", "heap_topk", "--limit", "2"]) == 0
    assert [set(json.loads(x)) for x in capsys.readouterr().out.splitlines()] == [{"event_id", "value"}] * 2
    assert main(["explain", "heap_topk"]) == 0 and "TakeOrderedAndProject" in capsys.readouterr().out
    assert main(["run", "nothing"]) == 2
