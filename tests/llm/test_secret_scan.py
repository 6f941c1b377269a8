import hashlib
import re

import corpus
import pytest

from promptgrid.llm import secret_scan

TOKEN = 'token = "' + "ab12" * 10 + '"'
AWS = "AKIA" + "Q" * 16


def plain(rows, rules=secret_scan.RULES):
    out = set()
    for r in rows:
        for rule, (version, pattern) in rules.items():
            found = re.findall(pattern, r[1] or "")
            for m in set(found):
                out.add((r[0], rule, version, hashlib.sha256(m.encode()).hexdigest(), found.count(m)))
    return out


def shown(paths):
    return {(r["doc_id"], r["rule"], r["rule_version"], r["secret_sha256"], r["occurrences"]) for r in paths.collect()}


def rows():
    texts = [f"a {TOKEN} b", f"x {AWS} y {AWS}", "clean", f"a {TOKEN} b", "ghp_" + "a1B2" * 9, "-----BEGIN RSA PRIVATE KEY-----", "xoxb-1234567890-abc", "postgres://me:hunter22@db.example.org/x", "eyJhbGciOi12.eyJzdWIiOi12.c2lnbmF0dXJl", f"{TOKEN} {AWS}", ""]
    return [corpus.row(i, t, source=f"s{i % 2}") for i, t in enumerate(texts)]


def test_findings_against_brute_force(spark):
    paths, _, findings = secret_scan.scan(corpus.frame(spark, rows()))
    assert shown(paths) == plain(rows())
    assert paths.where("doc_id in (0, 3)").select("path", "blob").distinct().count() == 2
    assert findings.select("blob").distinct().count() == 8
    secrets = [TOKEN, AWS]
    assert not any(s in str(r) for r in paths.collect() for s in secrets)


def test_assigned_tokens_in_any_case_and_unquoted(spark):
    value = "9233A8EC" * 4
    forms = [f'TOKEN = "{value}"', f"API_KEY='{value}'", f'Password: "{value}"', f"API-KEY: {value}", f"export ACCESS_KEY={value}", f"apikey: {value}", f'"Secret": "{value}"']
    clean = ['TOKEN = "short"', f"tokens {value}", 'password: "two words of 16 characters"', "api key=" + "a" * 15]
    paths = secret_scan.scan(corpus.frame(spark, [corpus.row(i, f"a {t} b") for i, t in enumerate(forms + clean)]))[0]
    assert sorted((r["doc_id"], r["rule"], r["rule_version"]) for r in paths.collect()) == [(i, "assigned_token", 2) for i in range(len(forms))]


def test_only_unseen_pairs_are_scanned(spark, monkeypatch):
    first, ledger, findings = secret_scan.scan(corpus.frame(spark, rows()))
    ledger, findings = ledger.cache(), findings.cache()
    assert ledger.count() == 10 * len(secret_scan.RULES)
    seen, passed = [], []
    matches, passing = secret_scan._matches, secret_scan._passed

    def spying(texts, rules):
        seen.append(sorted((r["text"], *(x for i, x in enumerate(rules) if r["missing"] >> i & 1)) for r in texts.select("text", "missing").collect()))
        return matches(texts, rules)

    def filtering(texts, need):
        passed.append(sorted(r["text"] for r in passing(texts, need).select("text").collect()))
        return passing(texts, need)

    monkeypatch.setattr(secret_scan, "_passed", filtering)

    monkeypatch.setattr(secret_scan, "_matches", spying)
    # the same table again: nothing to scan, all findings back
    paths, ledger, findings = secret_scan.scan(corpus.frame(spark, rows()), ledger, findings)
    assert seen == [[]] and passed == [[]] and shown(paths) == plain(rows())
    # a new text alone: nothing else goes as far as the shuffle
    extra = [*rows(), corpus.row(60, "only this")]
    secret_scan.scan(corpus.frame(spark, extra), ledger, findings)
    assert seen[1] == [("only this", *secret_scan.RULES)] and passed[1] == ["only this"]
    # one new text, one old text under a new path, one changed rule
    more = [*rows(), corpus.row(50, f"new {AWS}z"), corpus.row(51, "clean"), corpus.row(52, f"a {TOKEN} b")]
    rules = dict(secret_scan.RULES) | {"slack_token": (2, r"xox[abprs]-[0-9]{10,}")}
    paths, ledger, findings = secret_scan.scan(corpus.frame(spark, more), ledger, findings, rules)
    assert shown(paths) == plain(more, rules)
    assert seen[2] == sorted([*((t, "slack_token") for t in {r[1] for r in rows()}), (f"new {AWS}z", *rules)])


@pytest.mark.parametrize("case", ["empty", "edge", "wide"])
def test_frames(spark, case):
    docs = corpus.cases(spark)[case]
    paths, ledger, findings = secret_scan.scan(docs)
    assert paths.count() == 0
    assert ledger.count() == docs.where("text is not null").select("text").distinct().count() * len(secret_scan.RULES)


def test_ties_and_nulls(spark):
    odd = corpus.frame(spark, [corpus.row(1, TOKEN), corpus.row(1, TOKEN), (None, TOKEN, None, None, None), corpus.row(2, f"{TOKEN} {TOKEN}")])
    rows_ = secret_scan.scan(odd)[0].collect()
    assert sorted((r["path"], r["occurrences"]) for r in rows_) == [("a/1", 1), ("a/2", 2), ("null/null", 1)]


def test_query_in_two_scans(spark, tmp_path):
    from promptgrid.llm import queries

    many = [corpus.row(100 + i, f"{r[1]} PASSWORD: {'x9' * 9}", source=f"s{i % 3}") for i, r in enumerate(rows())]
    corpus.frame(spark, rows() + many).write.parquet(str(tmp_path / "documents.parquet"))
    assert shown(queries.op9_secret_scan(spark, str(tmp_path))) == plain(rows() + many)


def test_hot_blobs(spark):
    docs = corpus.frame(spark, [corpus.row(i, TOKEN if i % 2 else f"{AWS} {i}") for i in range(3000)])
    found = secret_scan.scan(docs)[0]
    assert sorted(r["doc_id"] for r in found.collect()) == list(range(3000))
