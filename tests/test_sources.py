import base64
import io
import subprocess
import zipfile
from email.message import EmailMessage

import pytest

from quietlake.sources import blobs, catalog, git, mail, sinks

b64 = lambda s: base64.b64encode(s.encode()).decode()

#: What the message below has, by the kind that each piece is reported as.
PIECES = {
    "PERSON": ["Oleander", "Quist"],
    "DATE_OF_BIRTH": ["1987-09-30"],
    "ADDRESS": ["905 Juniper Hollow Road"],
    "ZIP_CODE": ["97330"],
    "US_SSN": ["078-05-1120"],
    "PHONE_NUMBER": ["541.555.0177"],
    "RECORD_NUMBER": ["5550123", "44120987"],
    "IP_ADDRESS": ["172.20.3.8"],
    "EMAIL_ADDRESS": ["o.quist", "records.desk", "second.reader"],
}


def message() -> bytes:
    """A request with a plain and a marked-up body in different encodings, a spreadsheet, and a forwarded message."""
    p = PIECES
    m = EmailMessage()
    m["X-Mailer-Trace"] = f"hop {p['IP_ADDRESS'][0]}"
    m["From"] = f"{' '.join(p['PERSON'])} <{p['EMAIL_ADDRESS'][0]}@orchard.example>"
    m["To"] = f"{p['EMAIL_ADDRESS'][1]}@archive.example"
    m["Subject"] = f"copy of acct #{p['RECORD_NUMBER'][0]}"
    m["Date"] = "Fri, 06 Mar 2026 17:45:00 +0100"
    m.set_content(f"Name: {' '.join(p['PERSON'])}\nborn on {p['DATE_OF_BIRTH'][0]}, of {p['ADDRESS'][0]}, Corvallis OR {p['ZIP_CODE'][0]}\n", charset="iso-8859-1", cte="quoted-printable")
    m.add_alternative(f"<div>ring {p['PHONE_NUMBER'][0][:7]}<i>{p['PHONE_NUMBER'][0][7:]}</i></div><p>number <b>{p['US_SSN'][0][:6]}</b>{p['US_SSN'][0][6:]}</p>", subtype="html", cte="base64")
    m.add_attachment(b"\x00\x01cells", maintype="application", subtype="x-sheet", filename="oleander.sheet")
    inner = EmailMessage()
    inner["From"] = f"{p['EMAIL_ADDRESS'][2]}@orchard.example"
    inner["Subject"] = f"re: csn {p['RECORD_NUMBER'][1]}"
    inner.set_content("Nothing else to add.")
    m.add_attachment(inner)
    return m.as_bytes()


def test_mail_is_scrubbed_whole():
    raw = message()
    seen = mail.text_of(raw)
    out, report = mail.scrub(raw)
    text = mail.text_of(out)
    for kind, pieces in PIECES.items():
        for x in pieces:
            assert x in seen, x
            assert x not in text and x.encode() not in out, x
        if kind != "IP_ADDRESS":  # that one went with its header
            assert report.identifiers[kind] >= 1 and (kind == "EMAIL_ADDRESS" or f"<REDACTED:{kind}>" in text), kind
    assert report.identifiers["EMAIL_ADDRESS"] == 3 and not report.clean
    assert "redacted@archive.example" in text and "Fri, 06 Mar 2026" in text and "Nothing else to add." in text
    assert report.dropped_headers == {"x-mailer-trace": 1} and report.dropped_parts == ["application/x-sheet, 7 bytes"] and "application/x-sheet part removed (7 bytes)" in text


def test_a_sender_alone_is_a_finding():
    """A message without any other identifier isn't clean."""
    assert not mail.scrub(b"From: some.one@orchard.example\n\nnothing")[1].clean
    assert mail.scrub(b"Subject: plain\n\nnothing")[1].clean


@pytest.mark.parametrize("raw", [b"", b"\n\n", b"Subject: x", b"Content-Type: text/plain; charset=nope\n\n\xff hi", b"Content-Type: multipart/mixed; boundary=Q\n\nno parts"])
def test_odd_mail(raw):
    out, _ = mail.scrub(raw)
    assert isinstance(out, bytes) and isinstance(mail.text_of(raw), str)


def office(member, xml):
    f = io.BytesIO()
    with zipfile.ZipFile(f, "w") as z:
        z.writestr(member, xml)
    return f.getvalue()


def test_extract():
    assert blobs.extract("a/x.docx", office("word/document.xml", "<w:p><w:t>ring 541.555.</w:t><w:t>0177</w:t></w:p><w:p/>")).text.replace("\n", "") == "ring 541.555.0177"
    assert blobs.extract("x.xlsx", office("xl/sharedStrings.xml", "<si><t>a &amp; b</t></si>")).text == "a & b"
    assert blobs.extract("x.docx", b"broken").unscannable and blobs.extract("x.pdf", b"broken").unscannable and blobs.extract("x.doc", b"").unscannable
    assert blobs.extract("x.bin", b"a\0b").text == "" and blobs.extract("x.txt", b"\xffa").text == "�a"
    assert blobs.extract("x.txt", b"a" * 11, most=10).unscannable
    hidden = b"Content-Type: text/plain\nContent-Transfer-Encoding: base64\n\n" + b64("it is 078-05-1120").encode()
    assert "078-05-1120" in blobs.extract("m.eml", hidden).text


def test_files_are_scanned(spark, tmp_path):
    (tmp_path / "a.txt").write_text("fine\nit is 078-05-1120\nit is 078-05-1121 quietlake: allow\n")
    (tmp_path / "b.txt").write_text("quietlake: allow-file\nit is 078-05-1120\n")
    (tmp_path / "notes.md").write_text("it is 078-05-1120\n")
    (tmp_path / "big.txt").write_text("x" * 300)
    (tmp_path / "old.doc").write_bytes(b"x")
    (tmp_path / "k.txt").write_text("AKIA" + "A" * 16 + "\n")
    texts = blobs.read_files(spark, str(tmp_path), ("# comment", "notes.*"), most=200).cache()
    hits = blobs.scan_lines(texts)
    assert [(r["path"].rsplit("/", 1)[-1], r["line_no"], r["kinds"]) for r in hits.collect()] == [("a.txt", 2, ["US_SSN"])]
    s = blobs.scan_summary(texts, hits).first()
    assert (s["files"], s["files_with_hits"], s["unscannable"], s["blocked"]) == (5, 1, 2, True)
    assert [(r["line_no"], r["prefix"]) for r in blobs.find_secrets(texts).collect()] == [(1, "AKIA")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 1), (None, 2)], "x string, y int")
    sinks.write_csv(df, tmp_path / "r.csv")
    assert (tmp_path / "r.csv").read_text().splitlines() == ["x,y", '"a,b",1', ",2"]
    assert sinks.echo(df, 1).splitlines()[0] == "x    y"


def test_adapters(spark, sf_dir):
    catalog.adapter("files")(spark, sf_dir, ("region",))
    assert spark.table("region").count() == 5
    with pytest.raises(KeyError):
        catalog.adapter("none")
    with pytest.raises(ValueError):
        catalog.jdbc(spark, "jdbc:x://<host>", {})


@pytest.mark.parametrize(("url", "left"), [("jdbc:x://<host>/db", True), ("jdbc:x://example.com/db", True), ("jdbc:x://db.example.org:5432/a", True), ("jdbc:x://your-host/db", True), ("jdbc:x://u:p@example.net", True), ("jdbc:x://counterexample.io/db", False), ("jdbc:x://db.corp/example", False), ("jdbc:x://example-prod.corp/db", False)])
def test_placeholders(url, left):
    assert bool(catalog.PLACEHOLDER.search(url)) is left


def test_git(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@localhost", *a], check=True, capture_output=True)
    run("init", "-q")
    for name, text in (("a.txt", "fine\n"), ("b.txt", "it is 078-05-1120\n")):
        (tmp_path / name).write_text(text)
    run("add", ".")
    run("commit", "-qm", "one")
    (tmp_path / "b.txt").write_text("taken out\n")
    (tmp_path / "c.txt").write_text("ring 541.555.0177\n")
    (tmp_path / "d.log").write_text("ring 541.555.0178\n")
    run("add", ".")
    read = lambda what, **k: {r["path"] for r in blobs.scan_lines(git.read_git(spark, tmp_path, what, **k)).collect()}
    assert read("staged", ignore=("*.log",)) == {"c.txt"} and read("all") == {"c.txt", "d.log"}
    run("commit", "-qm", "two")
    assert {x.partition("@")[0] for x in read("HEAD")} == {"b.txt", "c.txt", "d.log"}  # b.txt as it was
    assert {x.partition("@")[0] for x in read("HEAD~1..HEAD")} == {"c.txt", "d.log"}
    assert {r["unscannable"] for r in git.read_git(spark, tmp_path, "all", most=3).collect()} == {"over 3 bytes"}


@pytest.mark.parametrize(("hits", "unscannable", "allow", "strict", "stops"), [(1, 0, True, False, True), (0, 0, False, True, False), (0, 2, False, False, True), (0, 2, True, False, False), (0, 2, True, True, True)])
def test_blocked(hits, unscannable, allow, strict, stops):
    assert blobs.blocked(hits, unscannable, allow, strict) is stops
