"""quill.operators"""
