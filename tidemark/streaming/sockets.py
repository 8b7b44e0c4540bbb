"""Streams from sockets: lines over TCP, and datagrams that each hold many lines.

A socket cannot be read again, so a batch that was received and not yet committed is lost
with its driver; use a file or message source where that matters.
"""

from __future__ import annotations

import socket
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

#: Largest datagram.
SIZE = 1 << 16


class DatagramReader(SimpleDataSourceStreamReader):
    """Receives what has come in; datagrams are kept until their batch is committed."""

    def __init__(self, options):
        self.most = int(options.get("maxPerBatch", "10000"))
        self.place = options.get("host", "127.0.0.1"), int(options["port"])
        self.socket = None  # bound where the stream runs; a reader is sent there as a whole
        self.held: dict[int, tuple[str, int]] = {}

    def _listen(self) -> None:
        if self.socket is None:
            self.socket = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
            self.socket.setsockopt(socket.SOL_SOCKET, socket.SO_REUSEADDR, 1)
            self.socket.bind(self.place)
            self.socket.setblocking(False)

    def initialOffset(self):
        self._listen()
        return {"n": 0}

    def read(self, start):
        self._listen()
        n = start["n"]
        for _ in range(self.most):
            try:
                data = self.socket.recv(SIZE)
            except BlockingIOError:
                break
            self.held[n] = (data.decode("utf-8", "replace"), int(time.time()))
            n += 1
        return self.readBetweenOffsets(start, {"n": n}), {"n": n}

    def readBetweenOffsets(self, start, end):
        return iter([self.held[i] for i in range(start["n"], end["n"]) if i in self.held])

    def commit(self, end):
        for i in [i for i in self.held if i < end["n"]]:
            del self.held[i]


class DatagramSource(DataSource):
    """Options: port, host (127.0.0.1 if not given), maxPerBatch."""

    @classmethod
    def name(cls):
        return "tidemark_datagram"

    def schema(self):
        return "value string, read_at bigint"

    def simpleStreamReader(self, schema):
        return DatagramReader(self.options)


def datagrams(spark: SparkSession, port: int, host: str = "127.0.0.1") -> DataFrame:
    """A stream of datagrams (value) and the second each was read."""
    spark.dataSource.register(DatagramSource)
    return spark.readStream.format("tidemark_datagram").option("port", port).option("host", host).load()


def socket_lines(spark: SparkSession, host: str, port: int) -> DataFrame:
    """A stream of the lines that a server at ``host`` sends, and the second each was read."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load().withColumn("read_at", F.unix_seconds(F.current_timestamp()))
