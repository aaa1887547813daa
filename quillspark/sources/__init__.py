"""Landed-data scans."""
