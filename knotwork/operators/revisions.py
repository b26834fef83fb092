"""A revision repository on Parquet: graphs by content hash, commits, refs, blobs, log.

Tables below the repository's folder: ng_revisions (a graph's triples by hash), ds_graphs (dataset revision to graph revisions),
commits, commit_parents, blobs, repo_log, and a folder of refs for each version. Content is only appended to, in partitions by the
first two digits of its hash, so what reads a revision reads its partition. Refs come last, under a new version number that only one
writer can take, so a reader sees a commit whole or not at all.

What a repository answers are functions of its tables, here beside the class; they work on any frames of that shape.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import COLUMNS, OWL, SCHEMA, conform
from .aggregates import digest, framed, graph_hash, tree_hash
from .graphs import checkpointed, closure, common_ancestor, reach

TABLES = {
    "ng_revisions": f"hash string, {SCHEMA}, hp string",
    "ds_graphs": "ds_hash string, ng string, hash string, hp string",
    "commits": "commit string, ds string, ds_hash string, author string, ts timestamp, message string",
    "commit_parents": "commit string, parent string, idx int",
    "blobs": "hash string, size long, data binary, hp string",
    "repo_log": "key long, fields map<string,string>",
    "refs": "ds string, kind string, name string, commit string",
}
#: The column whose first two digits name a row's partition.
PARTITION = {"ng_revisions": "hash", "ds_graphs": "ds_hash", "blobs": "hash"}
IMPORTS = f"{OWL}imports"
#: As many hashes as are pushed down as a list; beyond that they are joined, and only their partitions pushed down.
LISTED = 1000


def dataset_hash(graphs: DataFrame) -> DataFrame:
    """One row: the hash of a dataset revision, from its graphs' hashes (ng, hash) in any order."""
    return tree_hash(graphs.select(digest(F.concat(framed(F.col("ng")), framed(F.col("hash")))).alias("d")), name="ds_hash")


def version_hash(refs: DataFrame, commits: DataFrame) -> DataFrame:
    """One row: the hash of a repository's state, from its refs (ds, kind, name, commit) and commits (commit, ds_hash)."""
    of = lambda t, *cs: t.select(digest(F.concat(*(framed(F.col(c).cast("string")) for c in cs))).alias("d"))
    return tree_hash(of(refs, "ds", "kind", "name", "commit").union(of(commits, "commit", "ds_hash")), name="version")


def commit_hash(*parts: str) -> str:
    """SHA-256 of length-framed parts."""
    return hashlib.sha256(b"".join(f"{len(p.encode())}:".encode() + p.encode() for p in parts)).hexdigest()


def graph_changes(new: DataFrame, old: DataFrame) -> DataFrame:
    """Graphs that differ between two revisions (ng, hash): ng, change (added, deleted, modified). Compares hashes, not triples."""
    both = new.select("ng", F.col("hash").alias("new")).join(old.select("ng", F.col("hash").alias("old")), "ng", "full_outer").where("not (new <=> old)")
    return both.select("ng", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").otherwise("modified").alias("change"))


def unnamed_leaves(commits: DataFrame, parents: DataFrame, branches: DataFrame) -> DataFrame:
    """Commits that are no commit's parent and no branch's tip."""
    used = parents.select(F.col("parent").alias("commit")).union(branches.select("commit"))
    return commits.select("commit").distinct().join(used, "commit", "left_anti")


def commit_details(commits: DataFrame, parents: DataFrame, graphs: DataFrame) -> DataFrame:
    """Each commit with its parents in order (joined by commas) and how many graph revisions its dataset revision has."""
    up = parents.groupBy("commit").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", F.col("parent").cast("string").alias("parent")))), lambda x: x["parent"]), ",").alias("parents"))
    n = graphs.groupBy("ds_hash").agg(F.count_distinct("ng").alias("n_graphs"))
    out = commits.join(up, "commit", "left").join(n, "ds_hash", "left")
    return out.withColumn("parents", F.coalesce("parents", F.lit(""))).withColumn("n_graphs", F.coalesce("n_graphs", F.lit(0)))


def first_parents(parents: DataFrame) -> DataFrame:
    """Edges (a, b) from a commit to its first parent alone."""
    return parents.where("idx = 0").select(F.col("commit").alias("a"), F.col("parent").alias("b"))


def all_parents(parents: DataFrame) -> DataFrame:
    return parents.select(F.col("commit").alias("a"), F.col("parent").alias("b"))


def datasets(refs: DataFrame) -> DataFrame:
    return refs.where("ds <> ''").select("ds").distinct()


def log_page(log: DataFrame, start: int | None, end: int | None) -> DataFrame:
    """Log entries downwards from ``start`` (inclusive, the last if None) to ``end`` (exclusive); a negative end is a count."""
    out = log if start is None else log.where(F.col("key") <= start)
    if end is not None and end >= 0:
        out = out.where(F.col("key") > end)
    out = out.orderBy(F.desc("key"))
    return out.limit(-end) if end is not None and end < 0 else out


class Repository:
    """``conditions`` are called with the triples before a commit, and refuse it by raising; ``hooks`` with the commit's hash after it."""

    def __init__(self, spark: SparkSession, path: str, conditions: tuple[Callable[[DataFrame], None], ...] = (), hooks: tuple[Callable[[str], None], ...] = ()):
        self.spark, self.path, self.conditions, self.hooks = spark, path.rstrip("/"), conditions, hooks

    def _fs(self, name: str):
        """The Hadoop path of a part of the repository, and its file system."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _children(self, name: str) -> list[str]:
        at, fs = self._fs(name)
        return [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []

    def table(self, name: str) -> DataFrame:
        at, fs = self._fs(name)
        if not fs.exists(at):
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{name}")

    def _append(self, name: str, df: DataFrame) -> None:
        if key := PARTITION.get(name):
            df = df.withColumn("hp", F.substring(key, 1, 2)).repartition("hp").sortWithinPartitions("hp", key)
            df.select(*(c.split()[0] for c in TABLES[name].split(", "))).write.mode("append").partitionBy("hp").parquet(f"{self.path}/{name}")
        else:
            df.select(*(c.split()[0] for c in TABLES[name].split(", "))).write.mode("append").parquet(f"{self.path}/{name}")

    def _by_hash(self, name: str, wanted: DataFrame, key: str) -> DataFrame:
        """Rows of a partitioned table whose ``key`` is in ``wanted`` (the same column): reads their partitions alone."""
        some = [r[0] for r in wanted.select(key).distinct().limit(LISTED + 1).collect()]
        if len(some) <= LISTED:
            return self.table(name).where(F.col("hp").isin(sorted({h[:2] for h in some})) & F.col(key).isin(some))
        digits = [r[0] for r in wanted.select(F.substring(key, 1, 2)).distinct().collect()]  # 256 at most
        return self.table(name).where(F.col("hp").isin(digits)).join(wanted.select(key).distinct(), key, "left_semi").select(*self.table(name).columns)

    # refs

    def version(self) -> int:
        return max((int(x.partition("=")[2]) for x in self._children("refs") if x.startswith("version=")), default=0)

    def refs(self) -> DataFrame:
        """Current refs: ds, kind (branch or leaf), name, commit."""
        n = self.version()
        return self.spark.read.schema(TABLES["refs"]).parquet(f"{self.path}/refs/version={n}") if n else self.spark.createDataFrame([], TABLES["refs"])

    def _ref_rows(self) -> list[tuple]:
        return [tuple(r) for r in self.refs().collect()]  # as many as there are branches and unnamed leaves

    def _set_refs(self, rows: list[tuple], after: int) -> None:
        """Writes the refs that follow version ``after``; fails if another writer has done so."""
        lock, fs = self._fs(f"refs/_taken-{after + 1}")
        if not fs.createNewFile(lock):
            raise RuntimeError("another writer has changed the refs")
        self.spark.createDataFrame(rows, TABLES["refs"]).coalesce(1).write.mode("error").parquet(f"{self.path}/refs/version={after + 1}")

    def datasets(self) -> DataFrame:
        return datasets(self.refs())

    def branches(self, ds: str) -> DataFrame:
        return self.refs().where((F.col("ds") == ds) & (F.col("kind") == "branch")).select("name", "commit")

    def leaves(self, ds: str) -> DataFrame:
        return self.refs().where((F.col("ds") == ds) & (F.col("kind") == "leaf")).select("commit")

    # commits

    def commit(self, ds: str, triples: DataFrame, author: str, ts: str, message: str, branch: str = "master", parents: tuple[str, ...] = ()) -> str:
        """Writes a dataset's graphs as a revision and moves the branch to it.

        Graph revisions that the repository holds aren't written again. A branch tip that isn't among the
        parents becomes a leaf; parents that were leaves stop being ones."""
        triples, version = conform(triples), self.version()
        for holds in self.conditions:
            holds(triples)
        graphs = checkpointed(graph_hash(triples))
        ds_hash = dataset_hash(graphs).first()[0]
        commit = commit_hash(ds, ds_hash, author, ts, message, *parents)
        new = graphs.join(self._by_hash("ng_revisions", graphs, "hash").select("hash").distinct(), "hash", "left_anti")
        self._append("ng_revisions", triples.join(new, "ng"))
        if self.table("ds_graphs").where((F.col("hp") == ds_hash[:2]) & (F.col("ds_hash") == ds_hash)).isEmpty():
            self._append("ds_graphs", graphs.select(F.lit(ds_hash).alias("ds_hash"), "ng", "hash"))
        self._append("commits", self.spark.range(1).select(F.lit(commit).alias("commit"), F.lit(ds).alias("ds"), F.lit(ds_hash).alias("ds_hash"), F.lit(author).alias("author"), F.to_timestamp(F.lit(ts)).alias("ts"), F.lit(message).alias("message")))
        if parents:
            self._append("commit_parents", self.spark.createDataFrame([(commit, p, i) for i, p in enumerate(parents)], TABLES["commit_parents"]))
        rows = self._ref_rows()
        tip = next((r for r in rows if r[:3] == (ds, "branch", branch)), None)
        rows = [r for r in rows if r[:3] != (ds, "branch", branch) and not (r[0] == ds and r[1] == "leaf" and r[3] in parents)]
        if tip and tip[3] not in parents:
            rows.append((ds, "leaf", "", tip[3]))
        self._set_refs([*rows, (ds, "branch", branch, commit)], version)
        self.log({"type": "commit", "commit": commit, "ds": ds, "branch": branch, "message": message})
        for told in self.hooks:
            told(commit)
        return commit

    def set_branch(self, ds: str, branch: str, commit: str) -> None:
        """Moves a branch to a commit that some ref names; the old tip becomes a leaf."""
        version, rows = self.version(), self._ref_rows()
        if not any(r[0] == ds and r[3] == commit for r in rows):
            raise ValueError("no ref names this commit")
        old = [r for r in rows if r[:3] == (ds, "branch", branch)]
        rows = [r for r in rows if r[:3] != (ds, "branch", branch) and r != (ds, "leaf", "", commit)]
        rows += [(ds, "leaf", "", r[3]) for r in old if r[3] != commit and not any(x[3] == r[3] for x in rows)]
        self._set_refs([*rows, (ds, "branch", branch, commit)], version)
        self.log({"type": "set_branch", "ds": ds, "branch": branch, "commit": commit})

    def remove_branch(self, ds: str, branch: str) -> None:
        """Removes a branch; its tip becomes a leaf unless another ref names it."""
        version, rows = self.version(), self._ref_rows()
        old = [r for r in rows if r[:3] == (ds, "branch", branch)]
        rows = [r for r in rows if r[:3] != (ds, "branch", branch)]
        rows += [(ds, "leaf", "", r[3]) for r in old if not any(x[3] == r[3] for x in rows)]
        self._set_refs(rows, version)
        self.log({"type": "remove_branch", "ds": ds, "branch": branch})

    def log(self, fields: dict[str, str]) -> None:
        key = (self.table("repo_log").agg(F.max("key")).first()[0] or 0) + 1
        self._append("repo_log", self.spark.createDataFrame([(key, fields)], TABLES["repo_log"]))

    # reading

    def graphs_of(self, commit: str) -> DataFrame:
        """(ng, hash) of a commit's dataset revision."""
        row = self.table("commits").where(F.col("commit") == commit).select("ds_hash").first()
        if row is None:
            raise ValueError(f"no commit {commit}")
        return self.table("ds_graphs").where((F.col("hp") == row[0][:2]) & (F.col("ds_hash") == row[0])).select("ng", "hash")

    def revision(self, hash_: str) -> DataFrame:
        """The triples of one graph revision."""
        return self.table("ng_revisions").where((F.col("hp") == hash_[:2]) & (F.col("hash") == hash_)).select(*COLUMNS)

    def checkout(self, commit: str) -> DataFrame:
        """The triples of a commit: its graphs' hashes first, then only the partitions that hold them."""
        return self._by_hash("ng_revisions", self.graphs_of(commit), "hash").select(*COLUMNS)

    def checkout_branch(self, ds: str, branch: str = "master") -> DataFrame:
        row = self.branches(ds).where(F.col("name") == branch).first()
        if row is None:
            raise ValueError(f"{ds} has no branch {branch}")
        return self.checkout(row["commit"])

    def history(self, commit: str) -> DataFrame:
        """Ancestors of a commit, itself at depth 0, with author, time and message."""
        up = reach(all_parents(self.table("commit_parents")), self.spark.createDataFrame([(commit,)], "node string"))
        return up.join(self.table("commits"), F.col("node") == F.col("commit")).select("commit", "depth", "author", "ts", "message")

    def details(self) -> DataFrame:
        return commit_details(self.table("commits"), self.table("commit_parents"), self.table("ds_graphs"))

    def commit_diff(self, commit: str, parent: str) -> DataFrame:
        return graph_changes(self.graphs_of(commit), self.graphs_of(parent))

    def ancestor(self, x: str, y: str, first: bool = False) -> str | None:
        """The nearest common ancestor of two commits, over all parents or first ones alone."""
        row = common_ancestor((first_parents if first else all_parents)(self.table("commit_parents")), x, y).first()
        return row["node"] if row else None

    def ancestor_stage(self, x: str, y: str) -> DataFrame:
        """The triples that two commits both come from: the third side of a merge. Empty where they have no common ancestor."""
        base = self.ancestor(x, y)
        return self.checkout(base) if base else self.spark.createDataFrame([], SCHEMA)

    def import_closure(self, commit: str) -> DataFrame:
        """(importer, imported, depth): direct and indirect imports among a commit's stored graph revisions."""
        own = self._by_hash("ng_revisions", self.graphs_of(commit), "hash").where(F.col("p") == IMPORTS)
        return closure(own.select(F.col("ng").alias("a"), F.col("o").alias("b"))).toDF("importer", "imported", "depth")

    def info(self, branch: str | None = None) -> DataFrame:
        """One row of counts; of the commits that a branch's history holds alone, if one is given."""
        commits = self.table("commits")
        if branch is not None:
            tips = self.refs().where((F.col("kind") == "branch") & (F.col("name") == branch)).select(F.col("commit").alias("node"))
            commits = commits.join(reach(all_parents(self.table("commit_parents")), tips).select(F.col("node").alias("commit")), "commit", "left_semi")
        graphs = self.table("ds_graphs").join(commits.select("ds_hash").distinct(), "ds_hash", "left_semi")
        counts = [(commits, "commit", "n_commits"), (graphs, "ds_hash", "n_datasets"), (graphs, "hash", "n_revisions"), (self.table("repo_log"), "key", "n_log")]
        out = self.spark.range(1).select()
        for t, c, name in counts:
            out = out.crossJoin(t.agg(F.count_distinct(c).alias(name)))  # one row each
        return out

    def state(self) -> str:
        """A hash of refs and commits: two repositories with one hash hold the same."""
        return version_hash(self.refs(), self.table("commits")).first()[0]

    # blobs

    def put_blobs(self, blobs: DataFrame) -> None:
        """Stores ``blobs`` (data binary) by SHA-256; what is there stays."""
        new = blobs.where("data is not null").select(F.sha2("data", 256).alias("hash"), F.octet_length("data").cast("long").alias("size"), "data").dropDuplicates(["hash"])
        held = self.table("blobs").select("hash")
        self._append("blobs", new.join(held, "hash", "left_anti"))

    def blob(self, hash_: str) -> bytes | None:
        row = self.table("blobs").where((F.col("hp") == hash_[:2]) & (F.col("hash") == hash_)).select("data").first()
        return bytes(row[0]) if row else None

    def delete_blobs(self, hashes: DataFrame) -> None:
        """Removes blobs (hash): only the partitions that hold any are written anew."""
        digits = [r[0] for r in hashes.select(F.substring("hash", 1, 2)).distinct().collect()]  # 256 at most
        some = self.table("blobs").where(F.col("hp").isin(digits))
        rest = checkpointed(some.join(hashes.select("hash"), "hash", "left_anti").select("hash", "size", "data", "hp"))
        left = {r[0] for r in rest.select("hp").distinct().collect()}
        rest.repartition("hp").sortWithinPartitions("hp", "hash").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("hp").parquet(f"{self.path}/blobs")
        for d in set(digits) - left:
            at, fs = self._fs(f"blobs/hp={d}")
            fs.delete(at, True)

    # replication

    def sync_from(self, other: Repository, ds: tuple[str, ...] | None = None, branch: str | None = None) -> None:
        """Copies what ``other`` has and this lacks; content first, refs last. Branches that both have keep the own tip, and the
        other's becomes a leaf. With ``ds`` or ``branch`` only what those datasets' or that branch's tips lead to is copied."""
        version, refs = self.version(), other.refs()
        if ds is not None:
            refs = refs.where(F.col("ds").isin(*ds))
        if branch is not None:
            refs = refs.where((F.col("kind") == "branch") & (F.col("name") == branch))
        commits, parents, graphs, revisions = (other.table(t) for t in ("commits", "commit_parents", "ds_graphs", "ng_revisions"))
        if ds is not None or branch is not None:
            up = reach(all_parents(parents), refs.select(F.col("commit").alias("node"))).select(F.col("node").alias("commit"))
            commits, parents = commits.join(up, "commit", "left_semi"), parents.join(up, "commit", "left_semi")
            graphs = graphs.join(commits.select("ds_hash"), "ds_hash", "left_semi")
            revisions = revisions.join(graphs.select("hash").distinct(), "hash", "left_semi")
        for t, rows, key in (("ng_revisions", revisions, "hash"), ("ds_graphs", graphs, "ds_hash"), ("commits", commits, "commit"), ("commit_parents", parents, "commit")):
            self._append(t, rows.join(self.table(t).select(key).distinct(), key, "left_anti"))
        rows = self._ref_rows()
        named = {r[:3] for r in rows}
        for r in (tuple(x) for x in refs.collect()):
            if r[:3] not in named or r[1] == "leaf":
                rows.append(r)
            elif not any(x[3] == r[3] for x in rows):
                rows.append((r[0], "leaf", "", r[3]))
        self._set_refs(sorted(set(rows)), version)
        self.log({"type": "sync", "from": other.path})


class FlatRepository:
    """A repository without history: one partition per graph, written over by every commit."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def commit(self, triples: DataFrame) -> None:
        """Replaces the graphs that ``triples`` has; others stay."""
        t = conform(triples).select(*COLUMNS).repartition("ng")
        t.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ng").parquet(self.path)

    def checkout(self, *graphs: str) -> DataFrame:
        """All triples, or those of some graphs: their partitions alone are read."""
        t = self.spark.read.schema(SCHEMA).parquet(self.path).select(*COLUMNS)
        return t.where(F.col("ng").isin(*graphs)) if graphs else t


class Collection:
    """Repositories below one folder, by name; the empty name is ``default``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def open(self, name: str = "") -> Repository:
        """A repository, made if there is none of that name."""
        r = Repository(self.spark, f"{self.path}/{self._named(name)}")
        at, fs = r._fs("")
        fs.mkdirs(at)
        return r

    @staticmethod
    def _named(name: str) -> str:
        if "/" in name or name.startswith((".", "_")):
            raise ValueError("a repository's name is that of one folder")
        return name or "default"

    def names(self) -> list[str]:
        return sorted(Repository(self.spark, self.path)._children(""))

    def delete(self, name: str = "") -> None:
        at, fs = Repository(self.spark, f"{self.path}/{self._named(name)}")._fs("")
        if not fs.delete(at, True):
            raise ValueError(f"no repository {name}")
