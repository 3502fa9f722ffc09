"""Writers: tables, VCF, report."""
