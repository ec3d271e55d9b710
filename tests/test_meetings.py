"""Agendas, elections and merged mentions against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators import meetings as M

STATUS = [("rejected", r"부결|미가결|가결(?:되지|되지않|안됨|아니)"), ("passed", r"가결(?:됨)?$|원안(?:대로)?승인(?:됨)?$|승인(?:됨|되었음)$"), ("unresolved", "미결")]


def status(text):
    t = re.sub(r"\s", "", text)
    return next((s for s, p in [("withdrawn", "(?:안건|의안)(?:을|를)?철회"), ("not_tabled", "불상정|미상정|자동폐기"), *STATUS] if re.search(p, t)), None)


def agendas(phase, lines):
    """The grammar as a loop over lines, for lines of the few shapes made below."""
    out, active, now = [], True, None

    def close():
        if now and any(now["title"]):
            out.append((now["number"], " ".join(now["raw"]), " ".join(now["result"]) or None))

    for line in lines:
        if line in ("보고사항", "<부의안건>"):
            close()
            now, active = None, line != "보고사항"
            continue
        m = re.match(r"제(\d+(?:-\d+)*)호 의안: ?(.*)$", line) or (active and (re.match(r"(\d+)\. (.+)$", line) or re.match(r"(가)\. (.+)$", line)))
        point = re.match(r"ㆍ (.*)$", line)
        if not m and active and point and re.search("승인|선임", point[1]):
            m = (None, None, point[1])
        if m:
            number = m[1]
            if not (now and now["number"] and number and number.startswith(now["number"] + "-") and not now["result"]):
                close()
            now = {"number": number, "raw": [line], "title": [], "result": []}
            rest = m[2]
        elif now is None:
            continue
        elif phase == "result" and any(now["title"]) and (status(line) or line.startswith("→")):
            now["raw"].append(line)
            now["result"].append(line)
            continue
        else:
            now["raw"].append(line)
            if now["result"]:
                now["result"].append(line)
                continue
            rest = line
        cut = re.match(r"(.*?)(?:→\s*(.+)|\(\s*([^()]*)\s*\)|\s+-\s+(.+))\s*$", rest)
        said = cut and next((x.strip() for x in cut.groups()[1:] if x), "")
        if cut and (cut[2] or status(said)):
            rest = cut[1].strip()
        else:
            said = ""
        if rest:
            now["title"].append(rest)
        if phase == "result" and said:
            now["result"].append(said)
    close()
    return out


PIECES = ["보고사항", "<부의안건>", "제1호 의안: 재무제표 승인", "제1-1호 의안: 이사 홍길동 선임", "제1-2호 의안: 감사 선임 (가결)", "제2호 의안: 정관 변경 → 부결", "3. 배당", "가. 보수 한도", "ㆍ 감사 선임의 건", "ㆍ 기타", "→ 원안대로 승인", "가결", "설명 줄", "설명 - 승인됨", "제3호 의안:", "(부결)", "(참고)"]


@pytest.mark.parametrize("phase", ["notice", "result"])
def test_legacy_agendas(spark, phase):
    rnd = random.Random(4)
    docs = [(i, phase, [rnd.choice(PIECES) for _ in range(rnd.randint(0, 14))]) for i in range(400)]
    cells = spark.createDataFrame([(i, p, "\n".join(x)) for i, p, x in docs] + [(900, phase, None), (901, "unknown", PIECES[2])], "acpt_no long, phase string, cell string")
    found = M.legacy_agendas(M.agenda_lines(cells)).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.acpt_no, int(r.agenda_ref.split(":")[1]))):
        got.setdefault(r.acpt_no, []).append((r.number, r.title, r.result_raw))
        assert r.status == status(r.result_raw or "")
    for i, p, x in docs:
        assert got.get(i, []) == agendas(p, x), x
    assert 900 not in got and 901 not in got


def test_lines_with_several_agendas(spark):
    cases = {
        "제1호 의안: a 제2호 의안: b 제2-1호 의안: c": ["제1호 의안: a", "제2호 의안: b", "제2-1호 의안: c"],
        "안내 제1호 의안: a (제1호 참조) ◆ 제3호: b": ["안내 제1호 의안: a (제1호 참조)", "◆ 제3호: b"],
        "제2호 의안: 제1호의 변경": ["제2호 의안: 제1호의 변경"],
        "그냥 줄": ["그냥 줄"],
    }
    rows = spark.createDataFrame([(k,) for k in cases], "line string").select("line", M.split_agendas(F.col("line")).alias("x")).collect()
    assert {r.line: r.x for r in rows} == cases


@pytest.mark.parametrize(
    ("line", "active", "want"),
    [
        ("① 정관 변경", True, ("1", "정관 변경")),
        ("⑳ x", True, ("20", "x")),
        ("1-2. x", True, ("1-2", "x")),
        ("1.2 x", True, ("1-2", "x")),
        ("(3) x", True, ("3", "x")),
        ("(3) x", False, None),
        ("[제 4 호 의안] x", False, ("4", "x")),
        ("* 안건 5: x", False, ("5", "x")),
        ("제6안 x", False, ("6", "x")),
        ("나) x", True, ("나", "x")),
        ("- 이사 보수한도 승인", True, (None, "이사 보수한도 승인")),
        ("- 참고", True, None),
        ("제７호 의안 x", False, ("７", "x")),
    ],
)
def test_agenda_start(spark, line, active, want):
    got = spark.createDataFrame([(line, active)], "line string, a boolean").select(M.agenda_start(F.col("line"), F.col("a")).alias("s")).first().s
    assert (got and tuple(got)) == want


@pytest.mark.parametrize(
    ("title", "offices"),
    [("사외이사 홍길동 선임", ["outside_director"]), ("감사위원이 되는 사외이사 선임", ["audit_committee_member", "outside_director"]), ("사외이사가 아닌 감사위원 선임", ["audit_committee_member"]), ("상근감사 선임의 건", ["auditor"]), ("감사 보수한도 승인", []), ("사내이사 및 사외이사 선임", ["outside_director", "director"]), ("이사 선임", ["director"]), ("이사회 결의", []), (None, [])],
)
def test_office_types(spark, title, offices):
    got = spark.createDataFrame([(title,)], "t string").select(M.office_types(F.col("t")).alias("x")).first().x
    assert got == offices or (title and "아닌" in title and set(got) - {"director"} == set(offices))


def test_match_elections(spark):
    agenda = [
        (1, "a0", "사내이사 홍길동 선임", ["홍길동"]),
        (1, "a1", "사외이사 선임의 건", []),
        (1, "a2", "감사 John Smith 선임", None),
        (1, "a3", "이사 홍길순 해임", ["홍길순"]),
        (2, "b0", "사외이사 선임 1", []),
        (2, "b1", "사외이사 선임 2", []),
        (3, "c0", "사내이사 갑을병 선임", ["갑을병"]),
        (3, "c1", "사내이사 갑을병 재선임", ["갑을병"]),
        (None, "n", "사외이사 선임", []),
    ]
    election = [(1, "e0", "홍 길 동 (Gildong Hong)", "director"), (1, "e1", "김철수", "outside_director"), (1, "e2", "john smith", "auditor"), (1, "e3", "홍길순", "director"), (2, "f0", "박", "outside_director"), (3, "g0", "갑을병", "director"), (3, "g1", None, "director"), (None, "h", "x", "outside_director")]
    got = M.match_elections(spark.createDataFrame(election, "acpt_no long, election_ref string, name string, office string"), spark.createDataFrame(agenda, "acpt_no long, agenda_ref string, title string, candidates array<string>")).collect()
    assert {tuple(r) for r in got} == {(1, "e0", "a0", "name"), (1, "e1", "a1", "office"), (1, "e2", "a2", "name")}


def merged(mentions, relations):
    """Entities and relations of one document, one mention after the other."""
    ents, refs = {}, {}
    for at, kind, name, birth, evidence in mentions:
        name = " ".join((name or "").split())
        alias = None
        if kind == "person":
            m = re.fullmatch(r"(.+?)\s*\(([A-Za-z][A-Za-z .'-]+)\)", name)
            name, alias = (m[1], m[2]) if m else (name, None)
        else:
            name = name.strip("-–—,; ")
        birth = "" if kind != "person" or birth in (None, "-") else birth
        key = re.sub(r"[\s·ㆍ,]", "", name).lower()
        if key in ("", "-"):
            continue
        e = ents.setdefault((kind, key, birth), {"ref": f"{kind}:{sum(k[0] == kind for k in ents)}", "name": name, "birth": birth, "aliases": [], "mentions": []})
        if alias and alias not in e["aliases"]:
            e["aliases"].append(alias)
        if evidence not in e["mentions"]:
            e["mentions"].append(evidence)
        refs[str(at)] = e["ref"]
    out = {}
    for _, s, t, kind, attrs, evidence in relations:
        s, t = (x if re.match("@|agenda:", x) else refs.get(x) for x in (s, t))
        if not s or not t:
            continue
        told = attrs.get(M.TOLD_BY[kind], "") if kind in M.TOLD_BY else attrs.get("office_type") or attrs.get("action") or ""
        old = out.get((s, t, kind, told))
        attrs = {k: v for k, v in attrs.items() if v}
        if old is None:
            out[s, t, kind, told] = [len(out), attrs, evidence, [attrs["office_type"]] if "office_type" in attrs else []]
            continue
        if "office_type" in attrs and attrs["office_type"] not in old[3]:
            old[3].append(attrs["office_type"])
        old[1].update(attrs)
        if attrs.get("outcome"):
            old[2] = evidence
    for (_, _, kind, told), v in out.items():
        if kind == "subject_of" and told == "appointment" and len(v[3]) > 1:
            v[1].pop("office_type")
            v[1]["office_types"] = ",".join(v[3])
    return {(e["ref"], k[0], e["name"], e["birth"], tuple(e["aliases"]), tuple(e["mentions"])) for k, e in ents.items()}, {(v[0], *k[:3], tuple(sorted(v[1].items())), v[2]) for k, v in out.items()}


def test_merging_equals_a_loop(spark):
    rnd = random.Random(8)
    names = ["홍길동", "홍 길동", "홍길동 (Gil Hong)", "홍길동(G. Hong)", "김철수", "", "-", None, "Acme, Inc", "acme inc", "- Beta ;"]
    docs, rows, links = {}, [], []
    for doc in range(40):
        ms = [(i, rnd.choice(["person", "organization"]), rnd.choice(names), rnd.choice(["1970-01", "", None, "-", "1980-02"]), rnd.choice(["p1", "p2", "p3"])) for i in range(rnd.randint(0, 9))]
        rs = [(i, *(rnd.choice([str(rnd.randint(0, 9)), "@meeting", "agenda:1"]) for _ in "st"), rnd.choice(["subject_of", "serves_at", "candidate_for"]), {k: rnd.choice(v) for k, v in {"action": ["appointment", "removal"], "office_type": ["director", "auditor", ""], "position": ["CEO", ""], "outcome": ["", "passed", "rejected"]}.items() if rnd.random() < 0.8}, rnd.choice(["q1", "q2"])) for i in range(rnd.randint(0, 12))]
        docs[doc] = merged(ms, rs)
        rows += [(doc, *m) for m in ms]
        links += [(doc, *r) for r in rs]
    ents, refs = M.merge_entities(spark.createDataFrame(rows, "acpt_no long, at int, kind string, name string, birth_month string, evidence string"))
    rels = M.merge_relations(spark.createDataFrame(links, "acpt_no long, at int, source string, target string, type string, attributes map<string,string>, evidence string"), refs)
    got = {d: (set(), set()) for d in docs}
    for r in ents.collect():
        got[r.acpt_no][0].add((r.entity_ref, r.kind, r.name, r.birth_month, tuple(r.aliases), tuple(r.mentions)))
    for r in rels.collect():
        got[r.acpt_no][1].add((r.relation_no, r.source_ref, r.target_ref, r.type, tuple(sorted(r.attributes.items())), r.evidence))
    for d, want in docs.items():
        assert got[d] == want
