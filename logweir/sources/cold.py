"""Cold tier: an object store by Hadoop path, and a bounded local copy cache.

On a cluster, executors read cold files from the store; the cache serves a
single-node service, where a local copy is seen by every task.
"""

import os
import threading
from collections import OrderedDict

from logweir.functions.scalar import cache_filename, object_key


class ObjectStore:
    """Files of a bucket below any root that Hadoop knows (s3a://bucket, file:///...)."""

    def __init__(self, spark, root: str, bucket: str):
        self.root, self.bucket = root.rstrip("/"), bucket
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()

    @staticmethod
    def s3a_conf(endpoint: str, access_key: str, secret_key: str) -> dict[str, str]:
        """Session settings for an S3-compatible store."""
        return {"spark.hadoop.fs.s3a.endpoint": endpoint, "spark.hadoop.fs.s3a.access.key": access_key, "spark.hadoop.fs.s3a.secret.key": secret_key, "spark.hadoop.fs.s3a.path.style.access": "true"}

    def _path(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def url(self, uri: str) -> str:
        return f"{self.root}/{object_key(uri, self.bucket)}"

    def put(self, local: str, uri: str) -> None:
        """Upload under a temporary name, then rename, so that no reader sees part of a file."""
        fs, to = self._path(self.url(uri))
        _, tmp = self._path(self.url(uri) + ".part")
        src_fs, src = self._path(local)
        self._jvm.org.apache.hadoop.fs.FileUtil.copy(src_fs, src, fs, tmp, False, True, self._conf)
        fs.delete(to, False)
        if not fs.rename(tmp, to):
            raise OSError(f"could not move {tmp} to {to}")

    def get(self, uri: str, local: str) -> None:
        fs, src = self._path(self.url(uri))
        to_fs, to = self._path(f"file://{local}")
        self._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, src, to_fs, to, False, True, self._conf)

    def delete(self, uri: str) -> bool:
        """False if there was none: that counts as deleted."""
        fs, p = self._path(self.url(uri))
        return bool(fs.delete(p, False))

    def delete_path(self, path: str) -> bool:
        fs, p = self._path(path)
        return bool(fs.delete(p, False))


class ColdCache:
    """Least recently used files go until a new one fits; an oversize file is still kept (H6)."""

    def __init__(self, store: ObjectStore, folder: str, max_bytes: int = 10 << 30, metrics=None):
        self.store, self.folder, self.max_bytes, self.metrics = store, os.path.abspath(folder), max_bytes, metrics
        self._sizes: OrderedDict[str, int] = OrderedDict()
        self._lock = threading.Lock()
        os.makedirs(self.folder, exist_ok=True)

    def get_or_fetch(self, uri: str) -> str:
        local = os.path.join(self.folder, cache_filename(uri))
        with self._lock:
            if local in self._sizes and os.path.exists(local):
                self._sizes.move_to_end(local)
                if self.metrics:
                    self.metrics.add("cache_hits_total")
                return local
        if self.metrics:
            self.metrics.add("cache_misses_total")
        part = f"{local}.{threading.get_ident()}.part"
        self.store.get(uri, part)
        with self._lock:
            size = os.path.getsize(part)
            while self._sizes and sum(self._sizes.values()) + size > self.max_bytes:
                old, _ = self._sizes.popitem(last=False)
                if os.path.exists(old):
                    os.remove(old)
            os.replace(part, local)
            self._sizes[local] = size
        return local

    def resolve(self, path: str) -> str:
        return self.get_or_fetch(path) if path.startswith("s3://") else path
