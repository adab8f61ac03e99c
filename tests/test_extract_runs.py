"""Whole runs from the command line over small projects: files byte for byte, counts, logs and exit codes."""

import pytest

from tessella import cli


@pytest.fixture()
def project(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)

    def put(**files):
        for name, text in files.items():
            p = tmp_path / name.replace("__", "/").replace("_py", ".py").replace("_ftl", ".ftl")
            p.parent.mkdir(parents=True, exist_ok=True)
            p.write_bytes(text if isinstance(text, bytes) else text.encode())

    def run(*args):
        code = cli.main(["extract", "app", "locales", *args], spark)
        return code, capsys.readouterr().err.splitlines()

    def read(name):
        p = tmp_path / "locales" / name
        return p.read_bytes().decode() if p.exists() else None

    return put, run, read


def counts(log):
    return {line.split("  - ")[1].rpartition(": ")[0] if "{" not in line else line.split("  - ")[1].split(": {")[0]: line.rpartition(": ")[2].rstrip("}") for line in log if "  - " in line}


def test_first_run_makes_the_folder(project):
    put, run, read = project
    put(app__one_py='i18n.get("hello-user", name=1, age=2)\ni18n.menu.main(_path="wallet")\ni18n.get("hello-user", **k)\n', app__two_py='from x import L\nL("lazy", when=1)\ni18n.set_locale("x")\n', app__broken_py="def (\n")
    code, log = run("--ignore-kwargs", "when")
    assert code == 0 and read("en/_default.ftl") == "hello-user = hello-user{ $age }{ $name }\nlazy = lazy\n" and read("en/wallet/_default.ftl") == "menu-main = menu-main\n"
    assert counts(log) == {"Py files count": "2", "FTL files count": "0", "FTL keys in code": "3", "FTL keys stored": "3", "FTL keys updated": "0", "FTL keys added": "3", "FTL keys commented": "0"}
    before = read("en/_default.ftl")
    code, log = run("--ignore-kwargs", "when")
    assert code == 0 and read("en/_default.ftl") == before and counts(log)["FTL keys added"] == "0" and counts(log)["FTL files count"] == "2"


OLD = """### Title

## Group

same = Same { ref }
# Note of a
# stale entry
gone = Gone
    { $x }

    and more
changed = Old { $b }
moved = Moved
ref = Ref
-brand = B { gone2 }

# extract: ignore stale
marked = Stays { kept2 }
kept2 = Kept
# extract: ignore kwargs
hushed = Hushed { $other }
# ignore
plain = Only untranslated
last =
    .title = { same } { $t }
"""
CODE = 'i18n.get("same")\ni18n.get("changed", a=1)\ni18n.get("moved", _path="away/x.ftl")\ni18n.get("hushed", n=1)\ni18n.get("last")\ni18n.get("new")\n'


def test_existing_entries(project):
    """Places and blank lines: kept entries stay where they are, old forms are commented between blank lines, new keys follow."""
    put, run, read = project
    put(app__a_py=CODE, locales__en___default_ftl=OLD, locales__en__notes_ftl="# Only\n\n## comments\n")
    want = (
        "### Title\n\n\n## Group\n\nsame = Same { ref }\n"
        "\n# # Note of a\n# # stale entry\n# gone = Gone\n#     { $x }\n#\n#     and more\n\n"
        "\n# changed = Old { $b }\n\n\n# moved = Moved\n\n"
        "ref = Ref\n-brand = B { gone2 }\n# extract: ignore stale\nmarked = Stays { kept2 }\nkept2 = Kept\n# extract: ignore kwargs\nhushed = Hushed { $other }\n"
        "\n# # ignore\n# plain = Only untranslated\n\n"
        "last =\n    .title = { same } { $t }\nchanged = changed{ $a }\nnew = new\n"
    )
    code, log = run()
    assert code == 0 and read("en/_default.ftl") == want and read("en/away/x.ftl") == "moved = moved\n" and read("en/notes.ftl") == "# Only\n\n## comments\n"
    assert counts(log) == {"Py files count": "1", "FTL files count": "2", "FTL keys in code": "6", "FTL keys stored": "9", "FTL keys updated": "2", "FTL keys added": "1", "FTL keys commented": "4"}


def test_warning_and_dry_runs(project):
    put, run, read = project
    put(app__a_py=CODE, locales__en___default_ftl=OLD)
    code, log = run("--dry-run")
    assert code == 0 and read("en/_default.ftl") == OLD and counts(log)["FTL keys commented"] == "4"
    code, log = run("--comment-keys-mode", "warn")
    now = read("en/_default.ftl")
    assert code == 0 and "gone = Gone\n" in now and "changed = Old { $b }\n" in now and now.endswith("\nnew = new\n") and read("en/away/x.ftl") is None
    assert counts(log)["FTL keys stored"] == "11" and counts(log)["FTL keys commented"] == "4" and counts(log)["FTL keys updated"] == "2"
    assert [x for x in log if "WARN" in x] == [f"[WARN  cli] Key `{k}` in `locales/en/_default.ftl` is not in code (kwargs mismatch or missing)." for k in ("gone", "changed", "moved", "plain")]


def test_conflicts_and_unreadable_files(project):
    put, run, read = project
    put(app__a_py='i18n.get("p", _path="x.ftl")\ni18n.get("kw", a=1)\n', app__b_py='\ni18n.get("p", _path="y.ftl"); i18n.get("kw", b=1)\ni18n.get("kw", **z)\n', app__c_py="i18n.get('x'\n", app__d_py="é1\n".encode() + b"i \xff i18n\n")
    code, log = run()
    assert code == 1 and read("en/x.ftl") is None
    at = log.index("[ERROR cli] Extraction aborted: 4 problems found, no .ftl files were written.")
    assert log[at + 1].startswith("      - [parse-error] Failed to parse Python file: ") and log[at + 1].endswith("(app/c.py:1:9)")
    assert log[at + 2 : at + 5] == [
        "      - [invalid-utf8] Python file is not valid UTF-8: invalid utf-8 sequence of 1 bytes from index 6 (app/d.py:2:3)",
        "      - [key-message-conflict] Fluent key kw is used with different keyword arguments: a and b (app/a.py:2:1, app/b.py:2:31)",
        "      - [key-path-conflict] Fluent key p has different paths: x.ftl and y.ftl (app/a.py:1:1, app/b.py:2:1)",
    ]
    code, log = run("--allow-parse-errors")
    assert code == 1 and any("2 problems found" in x for x in log)


def test_skipped_files_comment_their_keys(project):
    put, run, read = project
    put(app__a_py='i18n.get("a")\n', app__c_py="i18n.get('x'\n", locales__en___default_ftl="a = A\nx = X\n")
    code, log = run("--allow-parse-errors")
    assert code == 0 and read("en/_default.ftl") == "a = A\n\n# x = X\n\n" and any(x.startswith("[WARN  cli] Skipping Python file: [parse-error]") for x in log)


def test_broken_catalogues(project):
    """All problems of catalogues at once: what a file holds first and how much more, and every place of a key that is there twice."""
    put, run, read = project
    put(app__a_py='i18n.get("a")\n', locales__en___default_ftl="a = A\nempty =\n  .attr\n= nothing\nb = B\n\n? odd\nstill odd\n", locales__en__b_ftl="t = 1\n-u = x\n", locales__en__c_ftl="x = { $y\n", locales__en__d__e_ftl="t = 2\n\nt = 3\n-u = y\n", locales__en__f_ftl=b"t = \xff")
    code, log = run()
    assert code == 1 and read("en/b.ftl") == "t = 1\n-u = x\n"
    assert log[log.index("[ERROR cli] Extraction aborted: 5 problems found, no .ftl files were written.") + 1 :] == [
        '      - Failed to parse FTL file locales/en/_default.ftl:2:1: Expected a message field for "empty" (and 1 more)',
        '      - Failed to parse FTL file locales/en/c.ftl:1:1: unbalanced braces in "x"',
        "      - Failed to read FTL file locales/en/f.ftl: invalid-utf8: invalid utf-8 sequence of 1 bytes from index 4 (1:5)",
        "      - Fluent key -u is defined more than once in locale en: en/b.ftl:2 and en/d/e.ftl:4",
        "      - Fluent key t is defined more than once in locale en: en/b.ftl:1, en/d/e.ftl:1 and en/d/e.ftl:3",
    ]


@pytest.mark.parametrize("mode,end", [("crlf", "\r\n"), ("cr", "\r"), ("lf", "\n")])
def test_languages_and_line_endings(project, mode, end):
    put, run, read = project
    put(app__a_py='i18n.get("a")\ni18n.get("b")\n', locales__uk__m_ftl="a = A\r\nz = Z\r\n")
    code, log = run("-l", "en", "-l", "uk", "--line-endings", mode, "--default-ftl-file", "m.ftl")
    assert code == 0 and read("en/m.ftl") == end.join(["a = a", "b = b", ""]) and read("uk/m.ftl") == end.join(["a = A", "", "# z = Z", "", "b = b", ""])
    assert '[INFO  cli]   - FTL keys added: {"en": 2, "uk": 1}' in log


def test_configuration_and_usage(project, tmp_path, spark, capsys):
    put, run, read = project
    put(app__a_py='T("a")\nself.T("b")\nother.T("c")\n', app__venv__v_py='T("hidden")\n')
    (tmp_path / "pyproject.toml").write_text('[tool.extract]\ncode-path = "app"\nlocales-path = "locales"\ni18n-keys = ["T"]\ni18n-keys-prefix = ["self"]\nlanguages = ["en", "de"]\n')
    assert cli.main(["extract", "-l", "fr"], spark) == 0
    assert read("fr/_default.ftl") == "a = a\nb = b\n" and read("en/_default.ftl") is None
    assert cli.main(["extract", "--line-endings", "odd"], spark) == cli.USAGE
    (tmp_path / "pyproject.toml").unlink()
    assert cli.main(["extract"], spark) == cli.USAGE
    assert cli.main(["config"]) == 0 and "[tool.extract]" in capsys.readouterr().out
