"""quill.plans"""
