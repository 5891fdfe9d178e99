"""Recorded pages of a paginated interface as a Spark data source: format("recorded_pages")."""

from __future__ import annotations

import json
import os

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class RecordedPages(DataSource):
    """Options: path - a folder with one folder per query, in it pages as <number>.json with `items` and `next`.

    Every query is a partition; its pages are followed by their `next` number from page 1, each page at most once, so
    a loop of pages ends. Yields (query, page, item_no, item_json, end_condition of the query's last page).
    """

    @classmethod
    def name(cls):
        return "recorded_pages"

    def schema(self):
        return "query string, page int, item_no int, item_json string, end_condition string"

    def reader(self, schema):
        return _Reader(self.options["path"])


class _Query(InputPartition):
    pass


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        return [_Query(q) for q in sorted(os.listdir(self.path)) if os.path.isdir(os.path.join(self.path, q))]

    def read(self, partition):
        query, page, seen, held = partition.value, 1, set(), []
        end = "exhausted"
        while page is not None:
            if page in seen:
                end = "cursor_loop"
                break
            seen.add(page)
            try:
                with open(os.path.join(self.path, query, f"{page}.json"), encoding="utf-8") as f:
                    body = json.load(f)
            except (OSError, ValueError):
                end = "page_missing"
                break
            held.extend((page, n, json.dumps(x, ensure_ascii=False, sort_keys=True)) for n, x in enumerate(body.get("items", [])))
            page = body.get("next")
        for page, n, item in held:
            yield query, page, n, item, end
