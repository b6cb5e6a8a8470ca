"""Part of auditlake; see README.md."""
