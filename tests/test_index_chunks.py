"""Chunks of an index do not grow in number with the blocks of a file."""

from strandline.sources import bgzf


def test_a_bin_over_many_blocks_is_one_chunk():
    index = bgzf.IndexBuilder()
    for k in range(900):  # three records a block of 10,000 bytes; the next block begins beyond the end of the one before
        block, place = divmod(k, 3)
        first = (block * 10_000 << 16) | place * 100
        index.add(0, 5, 25, first, first + 100)
    (chunks,) = [[tuple(c) for c in own] for own in index.bins[0].values()]
    assert len(chunks) == 3  # cut after each megabyte
    assert chunks[0][0] == 0 and chunks[-1][1] == (299 * 10_000 << 16) | 300

    assert bgzf.merged(chunks) == [(0, chunks[-1][1])]
