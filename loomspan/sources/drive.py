"""Document drives behind an HTTP API of sites, drives and items. The transport can be replaced."""

from __future__ import annotations

import json
import os
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.sources.files import listed_files, mime_type


def get_json(url: str, token: str) -> dict:
    request = urllib.request.Request(url, headers={"Authorization": f"Bearer {token}"})
    with urllib.request.urlopen(request, timeout=60) as r:
        return json.load(r)


def get_bytes(url: str, token: str) -> bytes:
    request = urllib.request.Request(url, headers={"Authorization": f"Bearer {token}"})
    with urllib.request.urlopen(request, timeout=300) as r:
        return r.read()


def client_token(authority: str, client_id: str, secret: str, scope: str) -> str:
    """A token by client credentials."""
    body = urllib.parse.urlencode({"client_id": client_id, "client_secret": secret, "scope": scope, "grant_type": "client_credentials"}).encode()
    with urllib.request.urlopen(urllib.request.Request(authority, body), timeout=60) as r:
        return json.load(r)["access_token"]


class Drive:
    """A site's default drive. ``get(url, token)`` gives JSON, ``fetch(url, token)`` bytes."""

    def __init__(self, api: str, token: str, get: Callable[[str, str], dict] = get_json, fetch: Callable[[str, str], bytes] = get_bytes):
        self.api, self.token, self.get, self.fetch = api.rstrip("/"), token, get, fetch

    def site_id(self, name: str | None = None, url: str | None = None) -> str:
        """By address, or the first site that a search for the name finds."""
        if (name is None) == (url is None):
            raise ValueError("give either a site's name or its address")
        if url:
            p = urllib.parse.urlparse(url)
            return self.get(f"{self.api}/sites/{p.netloc}:{p.path}", self.token)["id"]
        found = self.get(f"{self.api}/sites?search={urllib.parse.quote(name)}", self.token).get("value", [])
        if not found:
            raise ValueError(f"no site {name!r}")
        return found[0]["id"]

    def items(self, site: str, folder: str = "") -> Iterator[tuple[str, str | None, str, bool]]:
        """(id, parent_id, name, is_folder) of all that a folder holds, page by page."""
        drive = self.get(f"{self.api}/sites/{site}/drive", self.token)["id"]
        top = f"root:/{urllib.parse.quote(folder.strip('/'))}:/children" if folder.strip("/") else "root/children"
        todo: list[tuple[str | None, str]] = [(None, f"{self.api}/drives/{drive}/{top}")]
        while todo:
            parent, url = todo.pop()
            while url:
                page = self.get(url, self.token)
                for x in page.get("value", []):
                    yield x["id"], parent, x["name"], "folder" in x
                    if "folder" in x:
                        todo.append((x["id"], f"{self.api}/drives/{drive}/items/{x['id']}/children"))
                url = page.get("@odata.nextLink")

    def download(self, spark: SparkSession, site: str, target: str, folder: str = "") -> DataFrame:
        """Stores all files in a shared folder, on the executors; files that fail are left out."""
        drive = self.get(f"{self.api}/sites/{site}/drive", self.token)["id"]
        rows = list(self.items(site, folder))
        found = listed_files(spark.createDataFrame(rows, "id string, parent_id string, name string, is_folder boolean"))
        api, token, fetch = self.api, self.token, self.fetch

        def run(batches: Iterator) -> Iterator:
            import pandas as pd

            for pdf in batches:
                out = []
                for i, name in zip(pdf["id"], pdf["local_name"]):
                    try:
                        data = fetch(f"{api}/drives/{drive}/items/{i}/content", token)
                    except Exception:
                        continue
                    path = os.path.join(target, name)
                    Path(path).write_bytes(data)
                    out.append((path, path))
                yield pd.DataFrame(out, columns=["source", "path"])

        d = found.repartition(max(1, min(64, len(rows)))).mapInPandas(run, "source string, path string")
        return d.select("source", "path", mime_type(F.col("path")).alias("mime_type"), F.create_map().cast("map<string,string>").alias("metadata"))
