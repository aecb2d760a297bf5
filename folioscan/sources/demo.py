"""A small paper and its bibliography with planted faults, to try the audit on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PAPER = r"""\documentclass{article}
\title{A short paper with known faults}
\begin{document}
\section{Start}
Networks of layers are common~\citep{river2015layers}.
Sure! Here's your text in a shorter form.
Attention came later~\citep{stone2018focus, nobody2022dream}.
It's worth noting that a plethora of tools delve into it.
\section{Work}
We extend skip links~\citet{hill2016skip}. The **main point** is size.
As an AI language model, I am unable to run this.
Numbers are in [insert reference here].
\begin{verbatim}
As an AI language model, I am unable to help.
\end{verbatim}
I hope this helps. Let me know if anything is unclear.
\bibliography{refs}
\end{document}
"""
REFERENCES = """@inproceedings{river2015layers, title = {Layers Upon Layers}, author = {River, Ann}, year = {2015}}
@inproceedings{stone2018focus, title = {Focus Before Depth}, author = {Stone, Bo and Lake, Cy}, year = {2019}}
@inproceedings{hill2016skip, title = {Skipping Ahead}, author = {Hill, Di}, year = {2016}}
@article{nobody2022dream, title = {Dreamt Results in Imagined Swarms}, author = {Body, No}, year = {2022}, doi = {10.9999/none.1}}
"""


def demo(spark: SparkSession) -> DataFrame:
    """doc_id, file, filetype, text of the two sources."""
    return spark.createDataFrame([(1, "paper.tex", "tex", PAPER), (2, "refs.bib", "bib", REFERENCES)], "doc_id long, file string, filetype string, text string")
