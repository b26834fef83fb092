"""Command line: ``python -m knotwork REPOSITORY COMMAND ...``. Prints tables, a row a line, or writes files where a path is named."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import aggregates, patterns, search, setops, validate, vocab
from .operators.revisions import Collection, Repository, log_page
from .sources import p21, turtle, xmltree

ROWS = 1000


def shown(df: DataFrame, rows: int) -> None:
    """The columns' names, then rows, up to a number of them."""
    print("\t".join(df.columns))
    for r in df.limit(rows).collect():
        print("\t".join("" if v is None else str(v) for v in r))


def _read(spark: SparkSession, path: str) -> DataFrame:
    if path.endswith((".stp", ".step", ".p21")):
        return p21.read(spark, path)
    if path.endswith((".xml", ".svg")):
        return xmltree.read(spark, path)
    return turtle.read(spark, path).drop("_corrupt_record")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="knotwork", description=__doc__)
    p.add_argument("repository", help="folder of a repository, or of several (repositories, create, delete)")
    p.add_argument("--rows", type=int, default=ROWS, help="rows printed at most")
    c = p.add_subparsers(dest="command", required=True)

    def add(name: str, about: str, *args: str, **options: str) -> None:
        own = c.add_parser(name, help=about)
        for a in args:
            own.add_argument(a)
        for o, default in options.items():
            own.add_argument(f"--{o}", default=default)

    add("info", "counts", branch=None)
    add("datasets", "names of datasets")
    add("branches", "branches of a dataset", "ds")
    add("leaves", "commits that no branch leads to", "ds")
    add("log", "the log, newest first", count="10")
    add("commits", "all commits")
    add("history", "a commit's ancestors", "commit")
    add("commit-diff", "graphs that differ between two commits", "commit", "parent")
    add("diff", "triples that differ between two commits", "commit", "parent")
    add("checkout", "a commit's triples, as Turtle if a path is named", "commit", to=None)
    add("checkout-branch", "a branch's triples, as Turtle if a path is named", "ds", branch="master", to=None)
    add("graphs", "graphs of a commit", "commit")
    add("touching", "triples of a commit that a node is part of", "commit", "node")
    add("fragment", "nodes of a commit with a fragment", "commit", "fragment")
    add("import", "commits the triples of Turtle or TriG files", "ds", "path", branch="master", author="unknown", message="", parent=None)
    add("read", "what a file of any known format holds", "path")
    add("validate", "findings on a commit, judged by an ontology file", "commit", "ontology")
    add("query", "graphs of a commit whose labels a query string finds", "commit", "text", label="http://www.w3.org/2000/01/rdf-schema#label")
    add("set-branch", "moves a branch", "ds", "branch", "commit")
    add("remove-branch", "removes a branch", "ds", "branch")
    add("sync", "copies what another repository has", "other", ds=None, branch=None)
    add("blob", "writes a blob to a file", "hash", "to")
    add("put-blob", "stores files as blobs", "path")
    add("repositories", "names of repositories in this folder")
    add("create", "makes a repository in this folder", "name")
    add("delete", "removes a repository from this folder", "name")
    return p


def run(spark: SparkSession, argv: list[str]) -> None:
    a = parser().parse_args(argv)
    r, several = Repository(spark, a.repository), Collection(spark, a.repository)
    out: DataFrame | None = None
    match a.command:
        case "info":
            out = r.info(a.branch)
        case "datasets":
            out = r.datasets().orderBy("ds")
        case "branches":
            out = r.branches(a.ds).orderBy("name")
        case "leaves":
            out = r.leaves(a.ds)
        case "log":
            out = log_page(r.table("repo_log"), None, -int(a.count))
        case "commits":
            out = r.details().orderBy(F.desc("ts"), "commit")
        case "history":
            out = r.history(a.commit).orderBy("depth", "commit")
        case "commit-diff":
            out = r.commit_diff(a.commit, a.parent).orderBy("ng")
        case "diff":
            out = setops.diff(r.checkout(a.parent), r.checkout(a.commit)).orderBy("ng", "s", "p", "o")
        case "checkout" | "checkout-branch":
            t = r.checkout(a.commit) if a.command == "checkout" else r.checkout_branch(a.ds, a.branch)
            out = None if a.to else t
            if a.to:
                turtle.write(t, a.to)
        case "graphs":
            out = aggregates.graph_info(r.checkout(a.commit)).orderBy("ng")
        case "touching":
            out = patterns.touching(r.checkout(a.commit), a.node)
        case "fragment":
            out = patterns.by_fragment(r.checkout(a.commit), a.fragment)
        case "import":
            now = spark.sql("select date_format(current_timestamp(), 'yyyy-MM-dd HH:mm:ss')").first()[0]
            print(r.commit(a.ds, _read(spark, a.path), a.author, now, a.message, a.branch, (a.parent,) if a.parent else ()))
        case "read":
            out = _read(spark, a.path)
        case "validate":
            t, o = r.checkout(a.commit), turtle.read(spark, a.ontology)
            e, k = vocab.elements(o), vocab.kinds(o)
            out = validate.report(validate.types(t, e), validate.domain_and_range(t, e, vocab.inherited(e, k), k), validate.functional(t, e, k))
        case "query":
            docs = search.documents(r.checkout(a.commit), (a.label,))
            out = search.page(docs.where(search.condition(a.text, "label")), ["graph_uri"], 0, a.rows)
        case "set-branch":
            r.set_branch(a.ds, a.branch, a.commit)
        case "remove-branch":
            r.remove_branch(a.ds, a.branch)
        case "sync":
            r.sync_from(Repository(spark, a.other), (a.ds,) if a.ds else None, a.branch)
        case "blob":
            data = r.blob(a.hash)
            if data is None:
                raise SystemExit("no such blob")
            with open(a.to, "wb") as f:
                f.write(data)
        case "put-blob":
            r.put_blobs(spark.read.format("binaryFile").load(a.path).select(F.col("content").alias("data")))
        case "repositories":
            print("\n".join(several.names()))
        case "create":
            several.open(a.name)
        case "delete":
            several.delete(a.name)
    if out is not None:
        shown(out, a.rows)


if __name__ == "__main__":
    run(SparkSession.builder.appName("knotwork").getOrCreate(), sys.argv[1:])
