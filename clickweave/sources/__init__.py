"""Scans of the warehouse tables, ad-click sources and the test-data views."""
