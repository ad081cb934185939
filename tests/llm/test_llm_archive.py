import hashlib

from parchline.llm.archive import derived_records, record_text, write_archive

SCHEMA = "record_id string, target_uri string, warc_date string, headers map<string,string>, payload string, block string"
PAGE = (
    '<!DOCTYPE html><html lang="fa"><head><title>Dry &amp; wet\n months</title><style>p{}</style><script>var t="</p>";</script></head>'
    '<body><!-- <p>no</p> --><h1>Basin&#39;s&nbsp;rain &#x1F327; &amp;lt; &bad;</h1><p>One<br>two  three</p><a href="/a?b=1&amp;c=2">link</a> 1 < 2 &#38;gt;</body></html><script>open'
)


def derived(spark, rows):
    return derived_records(spark.createDataFrame(rows, SCHEMA))


def test_records_of_a_page(spark):
    rows = [("<urn:uuid:1>", "http://x/\r\nInjected: 1", "2024-01-01T00:00:00Z", {"Server": "s", "Content-Type": "text/html\r\nX: y"}, PAGE, "other")]
    made = {r.record_type: r for r in derived(spark, rows).collect()}
    text = made["conversion"]
    assert text.block == "Dry & wet months\nBasin's rain \U0001f327 &lt; &bad;\nOne\ntwo three\nlink 1 < 2 &gt;"
    assert made["metadata"].block == "title: Dry & wet months\r\nlanguage: fa\r\noutlink: /a?b=1&c=2\r\n"
    for r in made.values():
        assert (r.refers_to, r.warc_date, r.target_uri) == ("<urn:uuid:1>", "2024-01-01T00:00:00Z", "http://x/ Injected: 1")
        assert r.source_headers == "Content-Type: text/html X: y\nServer: s"
        assert r.content_length == len(r.block.encode()) and r.block_digest == "sha256:" + hashlib.sha256(r.block.encode()).hexdigest()
        assert r.payload_digest == "sha256:" + hashlib.sha256(PAGE.encode()).hexdigest()
    assert len({r.record_id for r in made.values()}) == 2


def test_all_named_references(spark):
    page = "<title>&copy; A&middot;B</title><p>caf&eacute; &mdash;&hellip;&rsquo; &copy 2024 &notit; &notin; &NotEqualTilde; &AMP;copy; &amp;copy; &#38;copy; AT&T &nosuch; a&b &"
    made = {r.record_type: r.block for r in derived(spark, [("a", "u", None, {}, page, None)]).collect()}
    assert made["conversion"] == "© A·B\ncafé —…’ © 2024 ¬it; ∉ ≂̸ &copy; &copy; &copy; AT&T &nosuch; a&b &"
    assert made["metadata"].startswith("title: © A·B\r\n")


def test_attributes_in_all_forms_and_what_opens_first(spark):
    page = (
        "<html class=x lang='de'><script>var c = '<!--';</script><p>one<style>/* <script> */</style><!-- <script> -->two<a title=\"see href=no\" data-href='no' HREF = '/q?a=\"1\"&amp;b'>x</a>"
        "<a href=/plain/>y</a><a class='k'href=\"/it's\">z</a><a name=here>w</a><abbr href=/no>v</abbr><a href=''>u</a>"
    )
    made = {r.record_type: r.block for r in derived(spark, [("a", "u", None, {}, page, None)]).collect()}
    assert made["conversion"] == "one" + "twoxyzwvu"
    assert made["metadata"] == "title: \r\nlanguage: de\r\noutlink: /q?a=\"1\"&b\r\noutlink: /plain/\r\noutlink: /it's\r\noutlink: \r\n"
    plain = {r.record_type: r.block for r in derived(spark, [("a", "u", None, {}, "<html lang=fr><a " + "b=c " * 50_000 + "href=d>", None)]).collect()}
    assert plain["metadata"] == "title: \r\nlanguage: fr\r\noutlink: d\r\n"


def test_nulls_long_pages_repeats_and_empty_table(spark):
    rows = [(None, None, None, None, None, None), ("a", "u", None, {}, "", None), ("b", "u", None, {"k": None}, "<p>x" * 50_000, None), ("b", "u", None, {"k": None}, "<p>x" * 50_000, None)]
    found = derived(spark, rows).collect()
    assert len(found) == 8
    assert {r.block for r in found if r.record_type == "conversion"} == {"", "\n".join(["x"] * 50_000)}
    assert len({r.record_id for r in found if r.refers_to == "b"}) == 2
    assert derived(spark, []).count() == 0


def test_written_archive_reads_back(spark, tmp_path):
    rows = [(f"<urn:uuid:{i}>", f"http://x/{i}", "2024-01-01T00:00:00Z", {"Server": "s"}, f"<p>é {i}\n</p><p>b", None) for i in range(5)]
    records = derived(spark, rows)
    write_archive(records, str(tmp_path / "out"))
    import gzip

    data = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "out").glob("*.gz")))
    expected, found = {r.record_id: r.block for r in records.collect()}, {}
    while data:
        head, data = data.split(b"\r\n\r\n", 1)
        lines = head.decode().split("\r\n")
        assert lines[0] == "WARC/1.1" and "WARC-Source-Server: s" in lines
        fields = dict(line.split(": ", 1) for line in lines[1:])
        n = int(fields["Content-Length"])
        found[fields["WARC-Record-ID"]], end, data = data[:n].decode(), data[n : n + 4], data[n + 4 :]
        assert end == b"\r\n\r\n" and fields["WARC-Refers-To"].startswith("<urn:uuid:")
    assert found == expected
    assert record_text(derived(spark, [(None, None, None, None, None, None)])).count() == 2
