"""A push feed over WebSocket as a streaming source.

The feed has no offsets: messages that arrive while nobody reads are lost, and
nothing is read again (at most once). Reading stops after ``max_messages``. The
client speaks the part of RFC 6455 that a feed needs; ``connect`` may be replaced
to read from elsewhere, e.g. in tests.
"""

from __future__ import annotations

import base64
import os
import socket
import ssl
import struct
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StringType, StructField, StructType

TEXT, CLOSE, PING, PONG = 1, 8, 9, 10


def _exactly(sock: socket.socket, n: int) -> bytes:
    out = b""
    while len(out) < n:
        got = sock.recv(n - len(out))
        if not got:
            raise ConnectionError("the feed was cut")
        out += got
    return out


def _send(sock: socket.socket, code: int, data: bytes) -> None:
    mask = os.urandom(4)
    size = bytes([0x80 | len(data)]) if len(data) < 126 else b"\xfe" + struct.pack(">H", len(data))
    sock.sendall(bytes([0x80 | code]) + size + mask + bytes(b ^ mask[i % 4] for i, b in enumerate(data)))


def messages(url: str, subscribe: str = "", timeout: float = 30) -> Iterator[str]:
    """Text messages of a feed until it says that it closes. A connection that is
    cut before that is an error, so a cut feed never looks complete."""
    at = urlsplit(url)
    secure = at.scheme == "wss"
    sock = socket.create_connection((at.hostname, at.port or (443 if secure else 80)), timeout)
    if secure:
        sock = ssl.create_default_context().wrap_socket(sock, server_hostname=at.hostname)
    with sock:
        path = (at.path or "/") + (f"?{at.query}" if at.query else "")
        key = base64.b64encode(os.urandom(16)).decode()
        sock.sendall(f"GET {path} HTTP/1.1\r\nHost: {at.netloc}\r\nUpgrade: websocket\r\nConnection: Upgrade\r\nSec-WebSocket-Key: {key}\r\nSec-WebSocket-Version: 13\r\n\r\n".encode())
        head = b""
        while not head.endswith(b"\r\n\r\n"):
            head += _exactly(sock, 1)
        if b" 101 " not in head.split(b"\r\n", 1)[0]:
            raise ConnectionError(head.split(b"\r\n", 1)[0].decode(errors="replace"))
        if subscribe:
            _send(sock, TEXT, subscribe.encode())
        parts = b""
        while True:
            first, second = _exactly(sock, 2)
            n = second & 0x7F
            n = struct.unpack(">H", _exactly(sock, 2))[0] if n == 126 else struct.unpack(">Q", _exactly(sock, 8))[0] if n == 127 else n
            data, code = _exactly(sock, n), first & 0x0F
            if code == CLOSE:
                _send(sock, CLOSE, data[:2])
                return
            if code == PING:
                _send(sock, PONG, data)
            elif code in (0, TEXT):
                parts += data
                if first & 0x80:
                    yield parts.decode()
                    parts = b""


class WebSocketReader(SimpleDataSourceStreamReader):
    #: Messages per micro-batch.
    BATCH = 500

    def __init__(self, options: dict, connect: Callable[..., Iterator[str]] = messages) -> None:
        self.options, self.connect, self.feed = options, connect, None
        self.most = int(options.get("max_messages", 0) or 0)

    def initialOffset(self) -> dict:
        return {"messages": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if self.feed is None:
            self.feed = self.connect(self.options["url"], self.options.get("subscribe", ""))
        room = min(self.BATCH, self.most - start["messages"]) if self.most else self.BATCH
        rows = []
        while len(rows) < room and (m := next(self.feed, None)) is not None:
            rows.append((m,))
        return iter(rows), {"messages": start["messages"] + len(rows)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(())  # a feed can't be read again

    def commit(self, end: dict) -> None:
        pass


class WebSocketSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tapeworks_websocket"

    def schema(self) -> StructType:
        return StructType([StructField("value", StringType())])

    def simpleStreamReader(self, schema: StructType) -> WebSocketReader:
        return WebSocketReader(self.options)
