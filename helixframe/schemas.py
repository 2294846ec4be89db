"""Schemas of the tables that the engine reads and writes. Positions count from 0; ranges exclude their end."""

ALIGNMENTS = "ord long, qname string, flag int, tid int, pos int, mapq int, cigar array<struct<op:string,len:int>>, mtid int, mpos int, isize int, l_qseq int, seq string, qual array<tinyint>"
CONTIGS = "tid int, contig string, length int"
SEQUENCE = "contig string, block_start int, bases string"
VARIANTS = "contig string, pos int, ref string, alt string, gt array<int>"
INTERVALS = "contig string, start int, end int"
WINDOWS = "contig string, start int, end int, mappable int, counts double, cn double, maf double"
SEGMENTS = "contig string, start int, end int, cn double"
CALLS = "contig string, start int, end int, cipos_lo int, cipos_hi int, ciend_lo int, ciend_hi int, srl int, srr int, nsnps int, cn float, rds float, pty float, mpb float, maf double"
