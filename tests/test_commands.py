from quietlake.__main__ import main


def test_commands(spark, sf_dir, tmp_path, capsys):
    base = ["--home", str(tmp_path / "h"), "--tables", sf_dir]
    (tmp_path / "p.yml").write_text("amber: ['*events']\ngreen: ['*region']\ndeny_columns: ['user_id']\ncount_columns: ['n']\n")
    base += ["--policy", str(tmp_path / "p.yml")]
    ok, bad = tmp_path / "ok.sql", tmp_path / "bad.sql"
    ok.write_text("SELECT event_type, count(*) AS n FROM events GROUP BY event_type;")
    bad.write_text("SELECT user_id FROM events")
    assert main([*base, "check", str(ok)], spark) == 0 and main([*base, "check", str(bad)], spark) == 1
    assert main([*base, "run", str(ok)], spark) == 0 and main([*base, "run", str(bad)], spark) == 1
    assert main([*base, "refresh", "--draft-policy"], spark) == 0 and main([*base, "schema", "even"], spark) == 0
    assert "event_type" in capsys.readouterr().out
    assert main([*base, "verify"], spark) == 0


def test_scrub_and_scan(spark, tmp_path, capsys):
    f = tmp_path / "in" / "a.txt"
    f.parent.mkdir()
    f.write_text("ssn 123-45-6789\n")
    assert main(["scrub", str(f), "--check"]) == 1
    assert main(["--home", str(tmp_path / "h"), "scan", str(f.parent)], spark) == 1
    assert main(["scrub", str(f), "--in-place"]) == 0 and f.read_text() == "ssn <REDACTED:US_SSN>\n"
    assert main(["scrub", str(f), "--check"]) == 0
    assert main(["--home", str(tmp_path / "h"), "scan", str(f.parent)], spark) == 0
    m = tmp_path / "m.eml"
    m.write_bytes(b"Subject: MRN 1234567\n\nhi")
    assert main(["scrub", str(m)]) == 0 and b"1234567" not in (tmp_path / "m.scrubbed.eml").read_bytes()
