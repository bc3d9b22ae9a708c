"""Executors: built-in data tools, tables, files, HTTP, processes and MCP servers."""
