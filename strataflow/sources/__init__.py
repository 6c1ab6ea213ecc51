"""Readers and writers: wells in CSV files, inventories, templates, model folders."""
