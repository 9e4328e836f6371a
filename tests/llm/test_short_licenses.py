from __future__ import annotations

from panelwright.llm import licenses


def test_texts_and_templates_shorter_than_a_window(docs, prose):
    mit = licenses.TEMPLATES["MIT permission"].split()
    gpl = "work is licensed under the GNU General Public License, version 3."
    rows = [(1, " ".join(mit[:-1])), (2, gpl), (3, " ".join(mit[:40])), (4, "x"), (5, None), (6, "Under CC0 here")]
    found, names = licenses.scan(docs(rows, extra=True))
    got = {r.doc_id: dict(zip(r[names[0]], r[names[1]])) for r in found.collect()}
    assert set(got[1]) == {"MIT permission"} and got[2] == {"GPL-3.0 notice": 7 / 8}
    assert not (got[3] or got[4] or got[5] or got[6])
    found, names = licenses.scan(docs(rows), {"CC0": "under CC0", "none": ""})
    assert {r.doc_id: r[names[0]] for r in found.collect() if r[names[0]]} == {6: ["CC0"]}
