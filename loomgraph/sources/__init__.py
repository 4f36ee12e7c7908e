"""Workspaces as tables: file listings, ignore rules, projects, and elements of source texts."""
