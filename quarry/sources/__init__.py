"""Readers and writers: file scans, snapshots, repository state and evaluation cases."""
