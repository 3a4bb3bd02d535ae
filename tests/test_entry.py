"""The driver contract with and without the training-data package."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(folder):
    code = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=folder, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    import json
    return json.loads(done.stdout.splitlines()[-1])


def test_queries_are_there_without_the_package(tmp_path):
    skip = shutil.ignore_patterns(".git", "llm", "__pycache__", "tests", "*.json", "*.md", "*.txt")
    for drop_pipeline in (False, True):
        copy = tmp_path / f"copy{drop_pipeline}"
        shutil.copytree(ROOT, copy, ignore=skip)
        if drop_pipeline and (copy / "corpus_pipeline.py").exists():
            (copy / "corpus_pipeline.py").unlink()
        queries, oracles = names(copy)
        assert len(queries) >= 149 and set(oracles) <= set(queries)
        assert not [q for q in queries if q.startswith("op") or q == "pipeline"]


def test_a_broken_package_is_not_forgiven(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "tests"))
    (copy / "answerscope" / "llm").mkdir()
    (copy / "answerscope" / "llm" / "__init__.py").write_text("")
    (copy / "answerscope" / "llm" / "queries.py").write_text("import no_such_module\n")
    code = "import __spark_entry__ as e; e.queries()"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert done.returncode != 0 and "no_such_module" in done.stderr
