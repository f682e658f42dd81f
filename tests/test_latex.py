r"""The LaTeX reader on small documents of our own, and on tables of files."""

import json

import pytest

from beliefmesh.sources import chunks, latex


def read(body, files=None, preamble=""):
    main = f"\\documentclass{{article}}\n{preamble}\\begin{{document}}\n{body}\n\\end{{document}}\n"
    return latex.read_files({"main.tex": main, **(files or {})}, "main.tex")


def texts(*a, **b):
    return [(c["unit"], c["text"]) for c in read(*a, **b)]


def sentences(*a, **b):
    return [c["text"] for c in read(*a, **b) if c["unit"] == "sentence"]


def test_sentences():
    assert sentences("One fell. Two rose! Did it? Yes.") == ["One fell.", "Two rose!", "Did it?", "Yes."]
    assert sentences("As in Fig. 3 it fell, cf. Smith. by A. Jones it rose.") == ["As in Fig. 3 it fell, cf. Smith. by A. Jones it rose."]
    assert sentences("It grew\nby $3$.\n\nThen not") == ["It grew by $3$.", "Then not"]
    assert sentences("It is $a.$ So $b. C$ holds. Next") == ["It is $a.$ So $b. C$ holds.", "Next"]
    assert sentences("He said ``no.'' She left.") == ["He said ``no.''", "She left."]
    assert sentences("Ends here.\\footnote{Or there. Maybe.} Next one.") == ["Ends here.", "Next one."]
    assert sentences("Fell % a remark. Really.\nagain. % more\n\nNew.") == ["Fell again.", "New."]
    assert sentences("\\section{Head} First. \\item Second \\item Third") == ["First.", "Second", "Third"]
    assert sentences("A \\emph{word. Inside} stays. B") == ["A \\emph{word. Inside} stays.", "B"]
    assert sentences("--- \\\\ ---") == [] and sentences("") == []
    assert sentences("at $4$ K. The rest") == ["at $4$ K.", "The rest"]


def test_units_and_order():
    body = r"""Text before\footnote{A note \cite{k1}.} goes on:
\begin{equation}\label{eq:one} x = 1 % hidden
\end{equation}
and \[ y \] ends.
\begin{figure}\includegraphics[w]{f}\caption[short]{A curve, \citep[see][p. 2]{k2, k3}.}\label{f}\end{figure}
\begin{tabular}{ll} a & b \end{tabular}
\begin{theorem} Inside. \end{theorem}
\begin{thebibliography}{9}\bibitem{k1} Lee, \newblock Title. \bibitem[x]{k2} Kim.\end{thebibliography}"""
    assert texts(body) == [
        ("sentence", "Text before goes on:"), ("footnote", "A note \\cite{k1}."), ("equation", "\\begin{equation} x = 1 \\end{equation}"), ("sentence", "and"), ("equation", "\\[ y \\]"), ("sentence", "ends."), ("caption", "A curve, \\citep[see][p. 2]{k2, k3}."), ("sentence", "Inside."), ("reference", "Lee, Title."), ("reference", "Kim."),
    ]
    got = read(body)
    assert got[1]["cites"] == ["k1"] and got[2]["labels"] == ["eq:one"] and got[6]["cites"] == ["k2", "k3"] and [c["key"] for c in got[-2:]] == ["k1", "k2"]
    assert [c["locator"] for c in got[:5]] == ["file=main.tex;lines=3-3", "file=main.tex;lines=3-3", "file=main.tex;lines=4-5", "file=main.tex;lines=6-6", "file=main.tex;lines=6-6"]
    assert [c["ord"] for c in got] == list(range(10))


def test_displays_of_all_kinds():
    for name in latex.DISPLAYS:
        assert texts(f"\\begin{{{name}}}a\\end{{{name}}}")[0][0] == "equation"
    assert texts("$$a$$ b") == [("equation", "$$a$$"), ("sentence", "b")]
    assert texts("\\begin{align}a\\label{p}\\\\b\\label{q}\\end{align}")[0][1] == "\\begin{align}a\\\\b\\end{align}" and read("\\begin{align}a\\label{p}\\\\b\\label{q}\\end{align}")[0]["labels"] == ["p", "q"]
    assert texts("\\begin{verbatim} Not. $this \\end{verbatim} But this.") == [("sentence", "But this.")]


def test_macros():
    pre = "\\newcommand{\\two}[2]{#1-#2}\\newcommand{\\opt}[2][x]{<#1,#2>}\\def\\old#1{(#1)}\\renewcommand{\\opt}[2][y]{[#1;#2]}\\providecommand{\\two}{no}\\providecommand{\\fresh}{yes}% \\def\\gone{x}\n"
    assert sentences("\\two{a}{b} \\opt{c} \\opt[d]{e} \\old{f} \\fresh{} \\gone.", preamble=pre) == ["a-b [y;c] [d;e] (f) yes{} \\gone."]
    assert sentences("\\deep a.", preamble="\\newcommand{\\deep}{\\deeper{} and}\\newcommand{\\deeper}{\\two}\\newcommand{\\two}{2}") == ["2{} and a."]
    assert sentences("\\loop x.", preamble="\\newcommand{\\loop}{l\\loop}") == ["l" * 32 + "\\loop x."]
    got = read("See \\seen{k9}. Next.", preamble="\\newcommand{\\seen}[1]{work\\footnote{In \\cite{#1}.}}")
    assert [(c["unit"], c["text"], c["cites"]) for c in got] == [("sentence", "See work.", []), ("footnote", "In \\cite{k9}.", ["k9"]), ("sentence", "Next.", [])]
    assert sentences("\\def\\here#1{<#1>}Then \\here{it}.") == ["Then <it>."]


def test_files():
    got = read("First. \\input{sec/a} After.\n\\bibliography{refs}", {"sec/a.tex": "In a.\n\\include{sec/b.tex}", "sec/b.tex": "\n\nIn b.", "main.bbl": "\\begin{thebibliography}{1}\n\\bibitem{z} Zed.\n\\end{thebibliography}"})
    assert [(c["text"], c["locator"]) for c in got] == [("First.", "file=main.tex;lines=3-3"), ("In a.", "file=sec/a.tex;lines=1-1"), ("In b.", "file=sec/b.tex;lines=3-3"), ("After.", "file=main.tex;lines=3-3"), ("Zed.", "file=main.bbl;lines=2-2")]
    assert sentences("\\use.", {"m.tex": "\\newcommand{\\use}{used}"}, "\\input{m}\n") == ["used."]
    for body, files in [("\\input{none}", {}), ("\\input{a}", {"a.tex": "\\input{a}"}), ("\\input{a}", {"a.tex": "\\include{b}", "b.tex": "\\input{a.tex}"})]:
        with pytest.raises(latex.LatexError):
            read(body, files)


@pytest.mark.parametrize("body", ["{ open", "$ open", "\\begin{equation} open", "\\cite{", "\\", "\\newcommand{\\x}", "\\begin", "}{", "\\footnote", "\\frac{1}", "\\verb|x|", "% only", "\\[ x", "\\def", "\\def\\x", "\\item[", "\\bibitem{a} b", "\\begin{figure}\\caption\\end{figure}", "\\newcommand{\\x}[z]{b}\\x"])
def test_unfinished_source_is_read(body):
    read(body)
    read("Fine. " + body + " Then. " * 3)


def test_long_paragraphs_take_linear_time():
    import time

    began = time.perf_counter()
    assert len(sentences("Word $x$ again. " * 4000)) == 4000
    assert time.perf_counter() - began < 60


def test_tables_of_documents(spark, tmp_path):
    rows = [("p", "main.tex", "\\begin{document}One. See \\cite{a,b}.\\begin{thebibliography}{1}\\bibitem{a} A.\\end{thebibliography}\\end{document}"), ("q", "x/paper.tex", "\\begin{document}\\input{part}\\end{document}"), ("q", "x/part.tex", "Two."), ("r", "m.tex", "\\begin{document}\\input{no}\\end{document}"), ("s", "m.tex", "nothing"), ("t", "m.tex", None)]
    files = spark.createDataFrame(rows, "document string, path string, text string")
    got = latex.read_latex(files).cache()
    assert sorted((r["document"], r["text"]) for r in got.where("error is null").collect()) == [("p", "A."), ("p", "One."), ("p", "See \\cite{a,b}."), ("q", "Two.")]
    assert {r["document"] for r in got.where("error is not null").collect()} == {"r", "s", "t"}
    nodes, relations, unresolved = chunks.chunk_graph(got.where("error is null"), {"reference": "entry"})
    own = {r["id"]: r for r in nodes.where("graph_id = 'p'").collect()}
    assert set(own) == {"s-1", "s-2", "r-1"} and own["r-1"]["kind"] == "entry" and json.loads(own["r-1"]["attributes"]) == {"origin": "document", "unit": "reference", "key": "a"}
    assert [tuple(r) for r in relations.select("graph_id", "id", "type", "source", "target").collect()] == [("p", "s-2-cites-r-1", "cites", "s-2", "r-1")] and [tuple(r) for r in unresolved.select("graph_id", "key").collect()] == [("p", "b")]
    (tmp_path / "d1" / "sec").mkdir(parents=True)
    (tmp_path / "d1" / "main.tex").write_text("\\begin{document}\\input{sec/a}\\end{document}")
    (tmp_path / "d1" / "sec" / "a.tex").write_text("Deep.")
    assert [(r["document"], r["text"], r["locator"]) for r in latex.read_latex(latex.latex_files(spark, str(tmp_path))).collect()] == [("d1", "Deep.", "file=sec/a.tex;lines=1-1")]
