"""A live level-0 feed over TCP as a streaming source: ``spark.readStream.format("level0")``.

A reader thread keeps the connection, cuts frames and lands them in ``spool``, a
folder that the cluster shares: files of numbered frames, written aside and renamed,
so that a frame is there whole or not at all.  Offsets are frame numbers, and the
numbers go on over restarts: a query that starts again reads what it had planned
once more from the files, then what came in the meantime.  Frames are read by the
executors, files are removed once a micro-batch that read them is committed, and
the thread reads no more from the socket while a file is being written, so nothing
piles up in a process.  One query reads a spool at a time.

A lost connection is made again ``attempts`` times at most, after waits that
double from ``delay`` to ``longest`` seconds; a silent one after ``timeout``
seconds, once more, and for good after ``stale`` seconds without a frame, whether
it is connected or not.
"""

from __future__ import annotations

import json
import posixpath
import re
import socket
import threading
import time
import uuid
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from mudline.sources.packets import CODES

#: Seconds and attempts of the feed's connection (fixed values).
SETTINGS = {"connect": 30.0, "timeout": 120.0, "stale": 300.0, "attempts": 10, "delay": 2.0, "longest": 60.0}
#: A file is written after so many frames, or so many seconds after its first one.
FILE_FRAMES, FILE_SECONDS = 10_000, 0.5
#: Frames that one task reads, about.
TASK_FRAMES = 100_000
NAMES = list(dict.fromkeys(CODES.values()))


def frame(lines: list[str]) -> tuple | None:
    """A packet's values from a frame's lines, 0 where a code is missing; None for an empty frame."""
    items: dict[str, float] = {}
    for line in lines:
        line = line.strip()
        if len(line) >= 5 and line[:4] in CODES:
            try:
                value = float(line[4:])
            except ValueError:
                continue
            if value == value and abs(value) != float("inf"):
                items[CODES[line[:4]]] = value
    return tuple(items.get(n, 0.0) for n in NAMES) if items else None


class Spool:
    """Numbered frames in files named by their first number and how many they hold."""

    def __init__(self, folder: str):
        self.where, self.root = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder) if ":" in folder else f"file://{folder}")
        self.where.create_dir(self.root, recursive=True)

    def files(self) -> list[tuple[int, int, str]]:
        """First number, frames and path of each file, in order."""
        names = (f.path for f in self.where.get_file_info(fs.FileSelector(self.root)) if f.base_name.endswith(".frames"))
        return sorted((*map(int, posixpath.basename(n)[: -len(".frames")].split("-")), n) for n in names)

    def put(self, first: int, rows: list[tuple]) -> None:
        aside = posixpath.join(self.root, f"_{uuid.uuid4().hex}")
        with self.where.open_output_stream(aside) as out:
            out.write("\n".join(json.dumps(r) for r in rows).encode())
        self.where.move(aside, posixpath.join(self.root, f"{first:020d}-{len(rows):09d}.frames"))

    def rows(self, path: str) -> list[tuple]:
        with self.where.open_input_file(path) as f:
            return [tuple(json.loads(line)) for line in f.read().decode().split("\n")]


class Connection:
    """The thread that reads frames (arrival in seconds, values) and lands them in the spool."""

    def __init__(self, host: str, port: int, settings: dict[str, float], spool: Spool):
        self.address, self.settings, self.spool = (host, port), settings, spool
        there = spool.files()
        self.next = there[-1][0] + there[-1][1] if there else 0
        self.rows: list[tuple] = []
        self.since, self.ended, self.connects = 0.0, False, 0
        self.lock = threading.Lock()
        threading.Thread(target=self.run, daemon=True).start()

    def connect(self) -> socket.socket | None:
        for attempt in range(int(self.settings["attempts"])):
            if attempt:
                time.sleep(min(self.settings["delay"] * 2 ** (attempt - 1), self.settings["longest"]))
            try:
                made = socket.create_connection(self.address, self.settings["connect"])
            except OSError:
                continue
            made.setsockopt(socket.SOL_SOCKET, socket.SO_KEEPALIVE, 1)
            self.connects += 1
            return made
        return None

    def land(self) -> int:
        """Writes what is held; returns the number that the next frame will have."""
        with self.lock:
            if self.rows:
                self.spool.put(self.next, self.rows)
                self.next, self.rows = self.next + len(self.rows), []
            return self.next

    def take(self, row: tuple) -> None:
        with self.lock:
            self.since = self.since if self.rows else time.time()
            self.rows.append(row)
        if len(self.rows) >= FILE_FRAMES:
            self.land()

    def run(self) -> None:
        last = time.time()
        while time.time() - last < self.settings["stale"] and (link := self.connect()) is not None:
            held, heard, silent = b"", time.time(), 0
            link.settimeout(min(FILE_SECONDS, self.settings["timeout"]))
            with link:
                while time.time() - last < self.settings["stale"]:
                    if self.rows and time.time() - self.since >= FILE_SECONDS:
                        self.land()
                    try:
                        got = link.recv(65536)
                    except TimeoutError:
                        if time.time() - heard >= self.settings["timeout"]:
                            heard, silent = time.time(), silent + 1
                        if silent > 1:
                            break
                        continue
                    except OSError:
                        break
                    if not got:
                        break
                    heard, silent = time.time(), 0
                    *whole, held = (held + got).split(b"!!")
                    for raw in whole:
                        row = frame(raw.decode("ascii", "replace").rpartition("&&")[2].splitlines())
                        if row is not None:
                            last = time.time()
                            self.take((int(last), *row))
            self.land()
        self.ended = True


class Files(InputPartition):
    """Frames from ``first`` to before ``last``, in these files."""

    def __init__(self, first: int, last: int, files: list[tuple[int, int, str]]):
        self.first, self.last, self.files = first, last, files


class FeedReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.address, self.folder = (options["host"], int(options["port"])), options.get("spool")
        if not self.folder:
            raise ValueError("spool must name a folder that the cluster shares")
        self.settings = {k: float(options.get(k, v)) for k, v in SETTINGS.items()}
        self.made: Connection | None = None

    @property
    def feed(self) -> Connection:
        """The connection, made where offsets are first asked for: Spark moves readers between processes before."""
        if self.made is None:
            self.made = Connection(*self.address, self.settings, Spool(self.folder))
        return self.made

    def __getstate__(self) -> dict:
        return self.__dict__ | {"made": None}

    def initialOffset(self) -> dict:  # noqa: N802
        there = Spool(self.folder).files()
        return {"frames": there[0][0] if there else 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"frames": self.feed.land()}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        first, last = start["frames"], end["frames"]
        files = [f for f in Spool(self.folder).files() if f[0] < last and f[0] + f[1] > first]
        if sum(min(f + n, last) - max(f, first) for f, n, _ in files) != max(last - first, 0):
            raise RuntimeError(f"frames {first} to {last} are no longer in the spool")
        out, held = [], 0
        for f in files:
            if not out or held >= TASK_FRAMES:
                out.append(Files(first, last, []))
                held = 0
            out[-1].files.append(f)
            held += f[1]
        return out

    def read(self, partition: Files) -> Iterator[tuple]:
        spool = Spool(self.folder)
        for first, _, path in partition.files:
            for number, row in enumerate(spool.rows(path), first):
                if partition.first <= number < partition.last:
                    yield row

    def commit(self, end: dict) -> None:
        spool = Spool(self.folder)
        for first, n, path in spool.files()[:-1]:  # the last file keeps the numbers going
            if first + n <= end["frames"]:
                spool.where.delete_file(path)


class Level0(DataSource):
    """Options: host, port, spool, and any of ``SETTINGS``."""

    @classmethod
    def name(cls) -> str:
        return "level0"

    def schema(self) -> str:
        return "timestamp long, " + ", ".join(f"{n} double" for n in NAMES)

    def streamReader(self, schema) -> FeedReader:  # noqa: ANN001, N802
        return FeedReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Level0)
